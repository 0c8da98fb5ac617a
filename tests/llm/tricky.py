"""Small tables with what real ones hold: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def alike(n: int) -> tuple[str, str]:
    """Two different words of n letters that sums of powers cannot tell apart: a Thue-Morse word and its complement."""
    word = "".join("ab"[k.bit_count() & 1] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def documents(seed: int = 0, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(120)] + ["É", "é", "ẞ", "x" * 300, "語", "A", "a", "!", "|", "***"]
    make = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = make(70)
    rows: list[tuple] = [(None, "no id at all", None, None, None), (1000, None, "en", "src0", 0), (1001, "", "en", "src1", 0), (1002, " \t\n ", None, "src2", 3), (1003, "one", "en", "other", 3)]
    base = make(200)
    for k in range(n):
        kind = k % 6
        if kind == 0:
            text = base
        elif kind == 1:
            w = base.split(" ")
            w[rng.randrange(len(w))] = f"edit{k}"
            text = " ".join(w)
        elif kind == 2:
            text = f"{make(30)}\n{passage} {make(15)}"
        elif kind == 3:
            text = f"{'again and again ' * 30}{make(5)}"
        elif kind == 4:
            text = base.upper()
        else:
            text = make(rng.choice([1, 2, 3, 4, 19, 20, 21, 400]))
        rows.append((k * 3 + 1, text, rng.choice(["en", "de", None]), f"src{rng.randrange(22)}", len(text)))
    rows.append((2000, make(40_000), "en", "src3", 0))  # very long
    for k, n in enumerate((1024, 2048, 4096)):
        for j, word in enumerate(alike(n)):
            rows += [(4000 + 10 * k + j, word, "en", "src4", n), (5000 + 10 * k + j, " ".join([word, *(f"z{k}x{i}" for i in range(12)), word, *(f"z{k}y{i}" for i in range(10)), word]), "en", "src5", 0)]
    rows.append(rows[7])  # repeated rows
    rows.append(rows[7])
    rng.shuffle(rows)
    return rows
