"""SimHash near-duplicates: fingerprints over word shingles, links at a small Hamming distance, components.

Defined results: a text without words (null, empty, white space) has fingerprint zero and is linked like any other;
fewer words than a shingle make one shingle. Rows without doc_id have a component but never name one; repeated rows
share theirs. Columns other than doc_id and text are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.frames import UPPER, map_rows, stored, whole_text
from quarry.llm.hamming import hamming_links

_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_BREAK = re.compile(rb"[\x20\x09-\x0d]")
SLAB = 1 << 20


def word_slabs(data: bytes, width: int) -> Iterator[list[bytes]]:
    """The words in slabs that overlap by width - 1 words, so that long texts take bounded memory."""
    at, carry = 0, []
    while at < len(data):
        end = len(data)
        if at + SLAB < end and (m := _BREAK.search(data, at + SLAB)):
            end = m.start()
        words = carry + data[at:end].translate(_LOWER).split()
        at = end
        if at >= len(data) or len(words) >= width:
            yield words
            carry = words[-(width - 1) :] if width > 1 else []
        else:
            carry = words


def simhash(data: bytes, width: int = 4, seed: int = 42) -> int:
    ones, total, digest = np.zeros(64, np.int64), 0, xxhash.xxh64_digest
    for k, words in enumerate(word_slabs(data, width)):
        text = b" ".join(words)
        if len(words) < width:
            if k or not words:
                continue
            parts = [digest(text, seed)]
        else:
            size = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(size + 1) - 1
            starts = (ends - size)[: len(words) - width + 1].tolist()
            parts = [digest(text[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
        total += len(parts)
        bits = np.unpackbits(np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    packed = np.packbits(2 * ones > total)
    return int.from_bytes(packed.tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, print (the 64 bits as a signed long)."""
    return map_rows(docs.select("doc_id", whole_text("text")), "doc_id long, print long", lambda: lambda row: ((row[0], simhash(row[1].encode(), width, seed)),))


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links)."""
    prints = stored(fingerprints(docs, width, seed), "prints")
    each = stored(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    links = stored(hamming_links(each.select("print"), radius), "links")
    roots = stored(components(links).withColumnRenamed("node", "print"), "roots")
    named = each.join(roots, "print")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(named.select("print", "root").join(least, "root").select("print", "component_id"), "classes")
    classes = each.join(classes, "print", "left").select("print", F.coalesce("component_id", "least").alias("component_id"))
    hexed = F.lpad(F.lower(F.hex("print")), 16, "0")
    return prints.join(classes, "print").select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id, all columns as they are.

    Rows without doc_id stay; of rows that repeat a doc_id one stays.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    stay = near_duplicates(named, width, radius, seed).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    one = named.join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.where(F.col("doc_id").isNull()))
