"""Engine settings: typed, validated, with a plain text round trip."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class EngineConf:
    import_batch_size: int = 20
    chunk_bytes: int = 1024 * 1024
    chunks_per_shard: int = 4
    aac_default_bitrate: int = 160_000
    flac_default_level: int = 4
    index_chunk_frames: int = 20_000
    index_target_chunk_kb: int = 512
    index_max_chunks: int = 50
    index_min_chunk_frames: int = 5_000
    worker_core_percent: int = 80
    memory_limit_mb: int = 500
    max_workers: int = 16
    ultrasound_threshold_hz: int = 96_000

    def __post_init__(self) -> None:
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, bool) or not isinstance(v, int):
                raise TypeError(f"{f.name} must be an integer, not {v!r}")
            if v < 1:
                raise ValueError(f"{f.name} must be positive, not {v}")
        if not 32_000 <= self.aac_default_bitrate <= 320_000:
            raise ValueError("aac_default_bitrate must be from 32000 to 320000")
        if self.flac_default_level > 12:
            raise ValueError("flac_default_level must be from 1 to 12")
        if self.worker_core_percent > 100:
            raise ValueError("worker_core_percent must be from 1 to 100")

    def with_values(self, **values: int) -> EngineConf:
        unknown = sorted(set(values) - {f.name for f in fields(self)})
        if unknown:
            raise AttributeError(f"no such setting: {', '.join(unknown)}")
        return replace(self, **values)

    def to_yaml(self) -> str:
        return "".join(f"{k}: {v}\n" for k, v in asdict(self).items())

    @classmethod
    def from_yaml(cls, text: str) -> EngineConf:
        pairs = (line.split("#")[0].partition(":") for line in text.splitlines() if line.split("#")[0].strip())
        return cls().with_values(**{k.strip(): int(v) for k, _, v in pairs})

    def workers(self, cores: int) -> int:
        return max(1, min(self.max_workers, cores * self.worker_core_percent // 100))
