"""Fill-in-middle transformation: texts cut at two drawn token bounds and put together as prefix, suffix and middle.

The ends of a text's tokens are a rising set of code-point offsets. It is held roaring-style: by the offset's high bits in
containers of 2**16 values, each an array, a bitmap or a list of runs, whichever is smallest, with the containers' cumulative
cardinalities. The k-th bound is found by a search of these and a select within one container.

Null and empty texts have no tokens and stay plain (output ''). A null key is drawn for as an empty one. Repeated rows get
equal results, as all depends on key and text only; columns of the input other than key and text, whatever their names, take
no part and are not returned. Texts of any length are cut whole: a worker holds one Arrow batch of texts and, of one
text at a time, its bounds.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, carried, chunks

carried(__name__)

SENTINELS = ("<P>", "<S>", "<M>")
WIDTH = 1 << 16  # values of a container
ARRAY_MOST = 4096  # values in two bytes each, beyond which a bitmap is smaller


class Bounds:
    """A set of offsets, built from rising ones, that gives its k-th smallest."""

    __slots__ = ("highs", "kinds", "parts", "below")

    def __init__(self, offsets: np.ndarray) -> None:
        high = offsets >> 16
        first = np.flatnonzero(np.diff(high, prepend=-1))
        self.highs = high[first].tolist()
        self.below = [*first.tolist(), len(offsets)]  # cumulative cardinalities
        made = [self._container(offsets[a:b] & (WIDTH - 1)) for a, b in zip(self.below, self.below[1:], strict=False)]
        self.kinds, self.parts = [k for k, _ in made], [p for _, p in made]

    @staticmethod
    def _container(low: np.ndarray) -> tuple[str, tuple]:
        """The smallest of: values; bitmap words and the number of bits before each; starts of runs and the number of values
        before each."""
        starts = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        if 4 * len(starts) < min(2 * len(low), WIDTH // 8):
            return "run", (low[starts].astype(np.uint16), starts.astype(np.uint16))
        if len(low) <= ARRAY_MOST:
            return "array", (low.astype(np.uint16),)
        bits = np.zeros(WIDTH, bool)
        bits[low] = True
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        return "bitmap", (words, np.cumsum(np.bitwise_count(words)) - np.bitwise_count(words))

    def __len__(self) -> int:
        return self.below[-1]

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        c = bisect_right(self.below, k) - 1
        k -= self.below[c]
        part = self.parts[c]
        if self.kinds[c] == "array":
            low = int(part[0][k])
        elif self.kinds[c] == "run":
            i = int(np.searchsorted(part[1], k, "right")) - 1
            low = int(part[0][i]) + k - int(part[1][i])
        else:
            i = int(np.searchsorted(part[1], k, "right")) - 1
            word = np.unpackbits(part[0][i : i + 1].view(np.uint8), bitorder="little")
            low = 64 * i + int(np.flatnonzero(word)[k - int(part[1][i])])
        return (self.highs[c] << 16) + low


def token_ends(data: np.ndarray, bounds: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Ends, in code points from their row's start, of the units of a run of rows, and each row's bounds among them. A token is a
    word with the white space before it; white space that ends a row is one of its own."""
    starts = (data & 0xC0) != 0x80
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(starts, out=points[1:])
    final = np.zeros(len(data), bool)
    final[bounds[1:][np.diff(bounds) > 0] - 1] = True
    if unit == "token":
        space = SPACES[data]
        ends = final | (~space & np.append(space[1:], True))
    else:
        ends = np.append(starts[1:], True)
    at = np.flatnonzero(ends) + 1
    own = np.searchsorted(at, bounds, "right")
    return points[at] - np.repeat(points[bounds[:-1]], np.diff(own)), own


def _cutter(unit: str):
    def cut(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        h1, h2 = first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False)
        out = np.zeros((3, len(texts)), np.int64)
        for row, data, bounds in chunks(texts):
            ends, own = token_ends(data, bounds, unit)
            for i, (a, b) in enumerate(zip(own.tolist(), own[1:].tolist(), strict=False), row):
                n = b - a
                x, y = int(h1[i]) % (n + 1), int(h2[i]) % (n + 1)
                if n:
                    held = Bounds(ends[a:b])
                    out[:, i] = n, held.select(min(x, y) - 1) if min(x, y) else 0, held.select(max(x, y) - 1) if max(x, y) else 0
        return pa.StructArray.from_arrays([pa.array(x) for x in out], ["n", "first", "second"])

    return F.arrow_udf(cut, "struct<n: bigint, first: bigint, second: bigint>")


def _checked(sentinels: Sequence[str]) -> Sequence[str]:
    """Raises unless no sentinel can begin within another, so that an output has one reading."""
    for a in sentinels:
        for b in sentinels:
            if not a or (a is not b and a in b) or any(a.endswith(b[:i]) for i in range(1, min(len(a), len(b)))):
                raise ValueError("sentinels must be distinct and must not overlap")
    return sentinels


def transformed(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, unit: str = "token", sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of every document: n units (tokens, or with unit='character' code
    points), and the text as it is (form plain) or, for `rate` percent of the keys, as prefix, suffix, middle (psm) or, for
    `spm` percent of these, suffix, prefix, middle (spm), each after its sentinel. The cuts, whether and how are drawn from
    the sha256 of seed and key. Empty texts and those that contain a sentinel stay plain, so every output can be undone."""
    if unit not in ("token", "character"):
        raise ValueError(f"no unit {unit}")
    p, s, m = (F.lit(x) for x in _checked(sentinels))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(F.col("h"), 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"), drawn.alias("h"))
    found = rows.select("k", "t", *[x.alias(f"h{i + 1}") for i, x in enumerate(h)]).withColumn("cut", _cutter(unit)("t", "h1", "h2"))
    marked = F.contains("t", p) | F.contains("t", s) | F.contains("t", m)
    form = F.when((F.col("t") == "") | marked | (F.pmod("h3", F.lit(100)) >= rate), "plain").when(F.pmod("h4", F.lit(100)) < spm, "spm").otherwise("psm")
    placed = found.select("k", "t", "cut.*", form.alias("form"))
    size = F.col("second") - F.col("first")
    part = {"prefix": F.substring("t", F.lit(1), F.col("first").cast("int")), "middle": F.substring("t", (F.col("first") + 1).cast("int"), size.cast("int")), "suffix": F.substring("t", (F.col("second") + 1).cast("int"), F.lit(2**31 - 1))}
    psm = F.concat(p, part["prefix"], s, part["suffix"], m, part["middle"])
    spm_text = F.concat(s, part["suffix"], p, part["prefix"], m, part["middle"])
    cut = F.col("form") != "plain"
    return placed.select(F.col("k").alias(key), "n", "form", F.when(cut, F.col("first")).alias("prefix_chars"), F.when(cut, size).alias("middle_chars"), F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_text).otherwise(F.col("t")).alias("output"))


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that an output of transformed() was made of."""
    pieces = F.split(output, "|".join("".join(f"\\{c}" if not c.isalnum() else c for c in x) for x in _checked(sentinels)))
    psm = F.concat(F.get(pieces, F.lit(1)), F.get(pieces, F.lit(3)), F.get(pieces, F.lit(2)))
    spm = F.concat(F.get(pieces, F.lit(2)), F.get(pieces, F.lit(3)), F.get(pieces, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


ORACLE_SQL = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
p AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM p),
x AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM x"""
