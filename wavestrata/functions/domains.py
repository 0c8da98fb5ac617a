"""Closed domains: target formats, sampling transforms and codec names."""

from __future__ import annotations

# Sample rates that a target format can name.
FLAC_RATES = (8000, 16000, 22050, 24000, 32000, 44100, 48000, 88200, 96000, 176400, 192000)
AAC_RATES = (8000, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000, 64000, 88200, 96000)
TRANSFORM_RATES = (8000, 16000, 22050, 24000, 32000, 44100, 48000, 88200, 96000)
FLAC_HIGHEST_RATE = 655_350
FLAC_MOST_CHANNELS = 8

TARGET_FORMATS: dict[str, tuple[str, int | None]] = {
    "FLAC": ("flac", None), **{f"FLAC_{r}": ("flac", r) for r in FLAC_RATES},
    "AAC": ("aac", None), **{f"AAC_{r}": ("aac", r) for r in AAC_RATES},
    "NUMPY": ("numpy", None),
}
TRANSFORMS: dict[str, tuple[str, int | None]] = {
    "EXACTLY": ("exactly", None), "RESAMPLING_NEAREST": ("resampling_nearest", None), **{f"RESAMPLING_{r}": ("resampling", r) for r in TRANSFORM_RATES},
    "REINTERPRETING_AUTO": ("reinterpreting", None), **{f"REINTERPRETING_{r}": ("reinterpreting", r) for r in TRANSFORM_RATES},
}

# Names of raw sample formats, and of codecs by how they compress. Names that begin
# with pcm_, dsd_ or adpcm_ and names like g722 go by rule.
RAW_NAMES = "pcm s16le s16be s24le s24be s32le s32be f32le f32be f64le f64be u8 s8 s302m".split()
LOSSLESS_NAMES = """
flac alac wavpack ape tak tta wv monkeys_audio ofr optimfrog wvpk apple_lossless m4a_lossless
mlp truehd shorten shn als ralf dst sonic
""".split()
LOSSY_NAMES = """
mp3 mp2 mp1 mpa mpega mp1float mp2float mp3float mp3adu mp3adufloat mp3on4 mp3on4float
aac aac_low aac_main aac_ssr aac_ltp aac_he aac_he_v2 libfdk_aac aac_fixed aac_at aac_latm
opus libopus vorbis libvorbis ogg
ac3 eac3 ac3_fixed eac3_core
wma wmav1 wmav2 wmapro wmavoice wmalossless
dts dca dtshd dtse
amrnb amrwb
gsm gsm_ms qcelp evrc sipr cook atrac1 atrac3 ra_144 ra_288 nellymoser truespeech
qdm2 imc mace3 mace6 adx xa sol_dpcm interplay_dpcm roq_dpcm xan_dpcm sdx2_dpcm
bmv_audio dsicinaudio smackaudio ws_snd1 paf_audio on2avc binkaudio_rdft binkaudio_dct qdmc speex libspeex
vmdaudio 4xm aptx aptx_hd sbc ldac real_144 real_288 8svx_exp 8svx_fib mpc7 mpc8
derf_dpcm gremlin_dpcm
acelp.kelvin libcodec2 libgsm libgsm_ms ilbc dss_sp
atrac3al atrac3plus atrac3plusal atrac9
fastaudio hca hcom iac interplayacm metasound smackaud twinvq xma1 xma2 siren
dolby_e dvaudio comfortnoise wavesynth
""".split()
