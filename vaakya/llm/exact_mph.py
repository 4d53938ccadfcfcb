"""Exact dedup against a minimal perfect hash over historical digests.

A text's digest is the SHA-256 of its text with every ``[\\x20\\x09-\\x0D]+`` replaced by one
space.  The digests of the *historical* rows, made distinct, are dealt to shards of bounded
size; each shard is a minimal perfect hash whose slots hold the full 32-byte digest, the
winner's doc_id and the number of copies.  Distinct digests of the other rows are looked up
in their shard and compared byte by byte with the slot: members are repeats and join the
slot's group; nonmembers form groups of their own.

Copies are counted before any shuffle (one row a digest and task), so a group of any size
costs a task no more than a single text.  Null text counts as empty, so null and empty texts
are one group.  Rows that repeat a doc_id stay together: each is kept if the doc_id is.  A
null doc_id never wins over another; a group of null doc_ids alone has a null keep_id.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaakya.llm import textbuf as tb
from vaakya.llm.scratch import materialise

#: Distinct digests a shard holds on average.
SHARD_ROWS = 100_000
#: Bits of the first array of a hash for each key.
LOAD = 2

SHARD_SCHEMA = "shard int, sizes array<long>, bits binary, digests binary, winners binary, copies binary"


def _positions(words: np.ndarray, level: int, size: int) -> np.ndarray:
    at = np.full(len(words), level + 1, np.uint64)
    for k in range(words.shape[1]):
        at = tb.mix(at * np.uint64(0x9E3779B97F4A7C15) + words[:, k])
    return (at % np.uint64(size)).astype(np.int64)


def build_hash(digests: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(sizes, bits) of a minimal perfect hash over distinct rows of an (n, 32) byte array.

    Level by level, keys that alone take a bit keep it and the others go on; a key's slot is
    the number of set bits before its own.
    """
    words = np.ascontiguousarray(digests).view(np.uint64).reshape(len(digests), digests.shape[1] // 8)
    left, sizes, levels = np.arange(len(digests)), [], []
    while len(left):
        size = max(8, LOAD * len(left))
        at = _positions(words[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        left = left[~alone[at]]
    return sizes, np.concatenate(levels) if levels else np.zeros(0, bool)


def slots(digests: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each digest; -1 if no level has a bit for it. Nonmembers may get any slot."""
    words = np.ascontiguousarray(digests).view(np.uint64).reshape(len(digests), digests.shape[1] // 8)
    out = np.full(len(digests), -1, np.int64)
    rank = np.concatenate([[0], np.cumsum(bits)])
    left, base = np.arange(len(digests)), 0
    for level, size in enumerate(sizes):
        if not len(left):
            break
        at = base + _positions(words[left], level, size)
        hit = bits[at]
        out[left[hit]] = rank[at[hit]]
        left, base = left[~hit], base + size
    return out


def _digests(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = _digests(pdf["digest"])
    sizes, bits = build_hash(keys)
    order = np.empty(len(keys), np.int64)
    order[slots(keys, sizes, bits)] = np.arange(len(keys))
    winners = pdf["first_id"].fillna(-1).to_numpy(np.int64)[order]
    known = pdf["first_id"].notna().to_numpy()[order]
    return pd.DataFrame(
        {
            "shard": [int(pdf["shard"].iloc[0])],
            "sizes": [sizes],
            "bits": [np.packbits(bits).tobytes()],
            "digests": [keys[order].tobytes()],
            "winners": [np.concatenate([winners, known.astype(np.int64)]).tobytes()],
            "copies": [pdf["copies"].to_numpy(np.int64)[order].tobytes()],
        }
    )


def look_up(shard: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """Groups of one shard: (digest, keep_id, group_size) with the members' copies added."""
    parts = []
    keys = _digests(new["digest"]) if len(new) else np.zeros((0, 32), np.uint8)
    member = np.zeros(len(keys), bool)
    if len(shard):
        row = shard.iloc[0]
        held = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        sizes = [int(x) for x in row["sizes"]]
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
        winners, known = np.frombuffer(row["winners"], np.int64).reshape(2, -1)
        keep = pd.Series(winners, dtype="Int64").where(pd.Series(known == 1))
        copies = np.frombuffer(row["copies"], np.int64).copy()
        if len(keys):
            at = slots(keys, sizes, bits)
            member = at >= 0
            member[member] = (held[at[member]] == keys[member]).all(1)
            found = at[member]
            copies[found] += new["copies"].to_numpy(np.int64)[member]
            theirs = pd.Series(new["first_id"].astype("Int64").array[member], index=found)
            keep = pd.concat([keep, theirs.reindex(range(len(keep)))], axis=1).min(axis=1).astype("Int64")
        parts.append(pd.DataFrame({"digest": [x.tobytes() for x in held], "keep_id": keep, "group_size": copies}))
    if len(keys):
        alone = new[~member]
        parts.append(
            pd.DataFrame(
                {
                    "digest": alone["digest"].to_numpy(),
                    "keep_id": alone["first_id"].astype("Int64").array,
                    "group_size": alone["copies"].to_numpy(np.int64),
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, historical: Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    ``historical`` tells the rows the hash is built over (by default about half of them, by
    a hash of doc_id); which rows it names changes the work and never the result.
    """
    if historical is None:
        historical = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rows = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.unhex(F.sha2(normalised(F.col("text").cast("string")), 256)).alias("digest"),
            F.coalesce(historical, F.lit(False)).alias("historical"),
        ),
        "digests",
    )

    def distinct(part: DataFrame, shards: int) -> DataFrame:
        seen = part.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
        return seen.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))

    past, new = rows.where("historical"), rows.where("NOT historical")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    index = materialise(distinct(past, shards).groupBy("shard").applyInPandas(build_shard, SHARD_SCHEMA), "mph")
    groups = (
        index.groupBy("shard")
        .cogroup(distinct(new, shards).groupBy("shard"))
        .applyInPandas(look_up, "digest binary, keep_id long, group_size long")
    )
    return rows.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
