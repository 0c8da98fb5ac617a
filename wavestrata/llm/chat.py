"""Chat formatting by prefix-target expansion.

A turn is written as ``<|turn|>role<|text|>text<|end|>``. Control strings inside roles and texts (the
template's and those of other common templates) are escaped: a backslash goes after their first
character, one more if they already have some; taking one away restores every text.

Every assistant turn becomes an example of its own: all turns before it are context, and its text
is the only trainable span. A conversation whose last turn is not an assistant's ends with one example
that holds all its turns and has no trainable span, so every turn is in the output. An example of
turn k holds k turns; that is what the method asks for, and a conversation's output grows with the square of its turns.

Rows: turns of a conversation go by turn, null first, then role and text among equal turns; each row is a
turn, repeated rows too. A null text or role is empty. Rows with a null conv_id form one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavestrata.llm.store import small_batches

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_CONTROL = r"(?:(?<=<)%s(?=\|turn\|>|\|text\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?<SYS>>|</SYS>>)|(?<=\[)%s(?=/?INST\]))"
_ESCAPE = re.compile(_CONTROL % (r"\\*", r"\\*"))
_UNESCAPE = re.compile(_CONTROL % (r"\\+", r"\\+"))
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)
_EXAMPLE = "conv_id long, example int, formatted string, mask array<struct<start: int, end: int>>"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][1:], text)


def examples(turns: list[tuple[str, str]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Formatted text and trainable spans, in characters, of each example of a conversation."""
    text = ""
    for k, (role, content) in enumerate(turns):
        head = f"{text}{TURN}{escape(role)}{TEXT}"
        text = f"{head}{escape(content)}{END}"
        if role == "assistant":
            yield text, [(len(head), len(text) - len(END))]
        elif k == len(turns) - 1:
            yield text, []


def read_back(formatted: str, mask: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], str]:
    """The turns of an example and the unescaped text under its mask."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)], "".join(unescape(formatted[a:b]) for a, b in mask)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, mask): one row an example, numbered from 0 in each conversation."""
    small_batches(conversations.sparkSession)
    turn = F.struct(F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                turns = [(t["role"], t["text"]) for t in batch.column(1)[i].as_py()]
                for k, (text, mask) in enumerate(examples(turns)):
                    rows.append((batch.column(0)[i].as_py(), k, text, [{"start": a, "end": b} for a, b in mask]))
                    size += len(text)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "example", "formatted", "mask"])
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "example", "formatted", "mask"])

    return whole.mapInArrow(expand, _EXAMPLE)


def summarize(formatted: DataFrame) -> DataFrame:
    """What the examples of each conversation say, read back from their texts and masks."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, k, text, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns, loss = read_back(text, [(m["start"], m["end"]) for m in mask])
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append((conv, k, len(turns), digest, loss, len(text)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", "example", "n", "digest", "loss", "chars"])

    parsed = formatted.mapInArrow(parse, "conv_id long, example int, n long, digest string, loss string, chars long")
    last = F.max(F.struct("example", "n", "digest"))
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x.loss), "")
    rows = parsed.groupBy("conv_id").agg(last.alias("last"), loss.alias("loss"), F.sum("chars").alias("formatted_chars"))
    return rows.select(
        "conv_id", F.col("last.n").alias("n_turns"), F.col("last.digest").alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars",
    )


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return summarize(format_conversations(given.unionByName(more)))


OP4_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)),
sized AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    length('<|turn|><|text|><|end|>') + length(role) + length(text) + len(regexp_extract_all(role, p)) + len(regexp_extract_all(text, p)) AS size
  FROM rows, (SELECT '<\\*(?:\|(?:turn|text|end|im_start|im_end|endoftext)\|>|/?s>|/?<SYS>>|</SYS>>)|\[\\*/?INST\]' AS p)
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
summed AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  (coalesce(sum(length(text)) FILTER (role = 'assistant'), 0))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR k = n))::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""
