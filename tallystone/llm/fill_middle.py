"""Fill-in-the-middle: documents cut at two ranked tokens and put in another order, and put back.

Tokens come from the tokenizers library: a Split pre-tokenizer that isolates the matches
of a pattern gives their offsets in code points, without any training. No token of the
pattern holds a space and a neighbour of it, so a text is cut at its spaces first and each
distinct piece goes through the library once; the offsets of a text follow from those of
its pieces. The number of offsets is n, and offsets by rank give the slices.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, small_batches
from .merges import Places

#: Fixed values of the task: the pattern of tokens and the three markers.
PATTERN = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents: those that are transformed, and of these, those whose suffix comes first.
RATE, SPM_RATE = 90, 20
#: Pieces whose offsets a task remembers; code points of a piece that the library gets at once.
CACHED_PIECES, LONG = 300_000, 1 << 16

_LETTERS = re.compile("[A-Za-z]+")


class Cutter:
    """Offsets of texts' tokens."""

    def __init__(self, cached: int = CACHED_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.split, self.cached = Split(Regex(PATTERN), "isolated"), cached
        self.forget()

    def forget(self) -> None:
        self.place, self.flat = Places(), np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1 << 14, np.int64)  # of piece k: flat[ends[k] : ends[k + 1]]

    def _offsets(self, piece: str) -> list[int]:
        """Where each token of a piece ends. Long pieces go in parts that no run of letters crosses."""
        at, out = 0, []
        while at < len(piece):
            end = at + LONG
            if end < len(piece) and (run := _LETTERS.match(piece, end - 1)):
                end = run.end()
            out += [at + e for _, (_, e) in self.split.pre_tokenize_str(piece[at:end])]
            at = end
        return out

    def _learn(self, pieces: list[str]) -> None:
        found = [self._offsets(p) for p in pieces]
        n, sizes = len(self.place) - len(pieces), np.fromiter(map(len, found), np.int64, len(found))
        used, new = int(self.ends[n]), int(sizes.sum())
        while len(self.place) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while used + new > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[used : used + new] = np.fromiter(chain.from_iterable(found), np.int32, new)
        self.ends[n + 1 : n + 1 + len(sizes)] = used + np.cumsum(sizes)

    def pieces(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of a text by number, and how many code points each has."""
        if len(self.place) > self.cached:
            self.forget()
        parts = text.split(" ")
        index = np.fromiter(map(self.place.__getitem__, parts), np.int64, len(parts))
        if self.place.new:
            self._learn(self.place.new)
            self.place.new = []
        return index, np.fromiter(map(len, parts), np.int64, len(parts))

    def cut(self, text: str, picks) -> tuple[int, list[int]]:
        """n, and where in the text the first k tokens end, for each k of picks(n)."""
        if not text:
            return 0, [0 for _ in picks(0)]
        index, length = self.pieces(text)
        # Tokens and code points before each piece; a space follows each piece but the last.
        tokens, points = np.cumsum(self.ends[index + 1] - self.ends[index] + 1), np.cumsum(length + 1)
        n, out = int(tokens[-1]) - 1, []
        for k in picks(n):
            p = int(np.searchsorted(tokens, k, side="right"))
            before, start = (int(tokens[p - 1]), int(points[p - 1])) if p else (0, 0)
            inside = k - before  # tokens of piece p
            out.append(start + (int(self.flat[self.ends[index[p]] + inside - 1]) if inside else 0))
        return n, out


@lru_cache(maxsize=1)
def cutter() -> Cutter:
    """One for each worker process."""
    return Cutter()


def draws(doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits that follow from an identifier."""
    digits = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[k : k + 8], 16) for k in (0, 8, 16, 24)]


def transform(text: str, doc_id: int | None, words: Cutter) -> tuple[int, str, int | None, int | None, str]:
    """n, form, the code points of prefix and middle (None where plain), and the output."""
    h1, h2, h3, h4 = draws(doc_id)
    n, (low, high) = words.cut(text, lambda n: sorted((h1 % (n + 1), h2 % (n + 1))))
    if not text or h3 % 100 >= RATE or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < SPM_RATE:
        return n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that an output was made of. No marker can arise across an edge of a slice: each starts and ends with signs of its own."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    body, _, middle = output[len(first) :].partition(MIDDLE)
    one, _, two = body.partition(second)
    return one + middle + two if form == "psm" else two + middle + one


_COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def _run(digests: bool):
    schema = _DIGESTS if digests else _COLUMNS
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches):
        words = cutter()
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part, cols = b.slice(at, 1024), [[] for _ in names]
                for i, t in zip(part["doc_id"].to_pylist(), part["text"], strict=True):
                    *row, output = transform(t.as_py(), i, words)
                    row += [sha(output), sha(restore(output, row[1]))] if digests else [output]
                    for c, v in zip(cols, (i, *row), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names)
        words.forget()

    return run, schema


def fill_middle(docs: DataFrame, digests: bool = False) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output for every row of docs (doc_id, text).

    With digests, the SHA-256 of the output and of the text that `restore` makes of it take
    the output's place. Cuts, form and order follow from doc_id alone; a null doc_id draws
    as the text "null" does and stays null. A null text counts as empty; an empty text, and
    one that holds a marker already, stay plain. Repeated rows give repeated rows; an empty
    table gives an empty result; other columns are ignored. No shuffle; a task holds a
    block of texts and the pieces that it knows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = small_batches(only(docs, "doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), text)
    return rows.mapInArrow(*_run(digests))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)


SQL = {
    "op12_fill_middle": """WITH a AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
b AS (SELECT *, CASE WHEN t = '' THEN [] ELSE regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') END AS u, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM a),
c AS (SELECT *, len(u) AS n, CAST(least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS BIGINT) AS lo, CAST(greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS BIGINT) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM b),
d AS (SELECT *, CASE WHEN lo > 0 THEN array_to_string(u[1:lo], '') ELSE '' END AS p, CASE WHEN hi > lo THEN array_to_string(u[lo + 1:hi], '') ELSE '' END AS m, CASE WHEN n > hi THEN array_to_string(u[hi + 1:n], '') ELSE '' END AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM d"""
}
