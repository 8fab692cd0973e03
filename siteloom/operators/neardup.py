"""Clusters of near-duplicate pages by MinHash and banded LSH."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.operators.components import connected_components
from siteloom.session import staged

# Fixed values.
HASHES, BANDS, ROWS, SHINGLE, THRESHOLD, FEWEST_TOKENS = 128, 16, 8, 5, 0.85, 50
#: Members of a band up to which all pairs of it are compared.
PAIRED = 32
#: Before each shingle, with the number of the hash; set it to compare signatures with another system.
SALT = "minhash-salt-"

_NO_WORD = re.compile(r"[^\w\s]|_")


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(1, 1 << 62, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 62, n, dtype=np.uint64)


def signature(runs: list[str], hashes: int = HASHES, mode: str = "fast", salt: str = SALT) -> list[int]:
    """The MinHash signature of distinct shingles.

    ``parity``: the i-th value is the least of the first eight hex digits of md5(salt i | shingle).
    ``fast``: one hash per shingle, then vectorised affine maps. Values of the modes aren't comparable.
    """
    if mode == "parity":
        encoded = [r.encode() for r in runs]
        return [int(min(hashlib.md5(p + r).hexdigest()[:8] for r in encoded), 16) for p in (f"{salt}{i}|".encode() for i in range(hashes))]
    base = np.array([int.from_bytes(hashlib.blake2b(r.encode(), digest_size=8).digest(), "little") for r in runs], np.uint64)
    a, b = _permutations(hashes)
    with np.errstate(over="ignore"):
        return ((np.multiply.outer(a, base) + b[:, None]).min(axis=1) >> np.uint64(32)).astype(np.int64).tolist()


def signatures(pages: DataFrame, key: str, text: str, mode: str = "fast", shingle: int = SHINGLE, hashes: int = HASHES, fewest: int = FEWEST_TOKENS, salt: str = SALT) -> DataFrame:
    """``key, n_tokens, sig`` of every text with at least ``fewest`` tokens. Texts are tokenised, shingled
    and hashed where they are read, in Arrow batches: Catalyst's distinct over arrays of strings is quadratic."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, counts, sigs = [], [], []
            for i, body in enumerate(batch.column(text).to_pylist()):
                tokens = shingle_words(body)
                if len(tokens) >= max(fewest, shingle):
                    keep.append(i)
                    counts.append(len(tokens))
                    sigs.append(signature(sorted({" ".join(tokens[j : j + shingle]) for j in range(len(tokens) - shingle + 1)}), hashes, mode, salt))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(keep, pa.int64())), pa.array(counts, pa.int32()), pa.array(sigs, pa.list_(pa.int64()))], names=[key, "n_tokens", "sig"])

    return pages.where(F.col(text).isNotNull()).select(key, text).mapInArrow(sign, f"{key} {dict(pages.dtypes)[key]}, n_tokens int, sig array<bigint>")


def shingle_words(text: str) -> list[str]:
    """Lower case, letters and digits of any script, two characters or more."""
    return [t for t in _NO_WORD.sub(" ", text.lower()).split() if len(t) >= 2]


def _met(keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The pairs of signatures ``a, b`` that share a key of at most ``PAIRED`` members, and the other keys with their least and greatest member."""
    groups = keys.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("n > 1")
    near = keys.join(groups.where(F.col("n") <= PAIRED).select(key), key, "left_semi")
    pairs = near.select(key, F.col("sid").alias("a")).join(near.select(key, F.col("sid").alias("b")), key).where("a < b").select("a", "b")
    return pairs, groups.where(F.col("n") > PAIRED).select(key, "lo", "hi")


def similar_signatures(signed: DataFrame, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``a, b, similarity`` between different signatures (``sid``) that share a band and agree in at least ``threshold`` of their values.

    Equal signatures are one ``sid``, so copies make no pairs. The members of a band are all compared if they are at most ``PAIRED``.
    A larger band is taken apart by the members' other bands: signatures that agree in 85 % of their values share a second
    band with a probability of 99 %. What is still large then are signatures that share two bands or more; each is linked to
    the least and the greatest of them. So work is linear in any band, and clusters, which are
    connected by links, lose next to nothing.
    """
    at = lambda i: F.xxhash64(i, F.slice("sig", i * rows + 1, rows))
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), at))
    keys = staged(signed.select("sid", band.alias("band")), "bands")
    pairs, hot = _met(keys, "band")
    hot = staged(hot.select("band"), "hot-bands")
    if not hot.isEmpty():
        members = keys.join(hot, "band", "left_semi").withColumnRenamed("band", "hot")
        finer = staged(members.join(keys, "sid").where("hot != band").select("sid", F.xxhash64(F.least("hot", "band"), F.greatest("hot", "band")).alias("key")).distinct(), "finer-bands")
        more, groups = _met(finer, "key")
        stars = finer.join(groups, "key").select("sid", F.explode(F.array("lo", "hi")).alias("rep")).where("sid != rep").select(F.least("sid", "rep").alias("a"), F.greatest("sid", "rep").alias("b"))
        pairs = pairs.unionByName(more).unionByName(stars)
    pairs = pairs.distinct()
    sig = signed.select("sid", "sig")
    both = pairs.join(sig.select(F.col("sid").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("sid").alias("b"), F.col("sig").alias("sb")), "b")
    agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda v: v)) / F.size("sa")
    return both.select("a", "b", agree.alias("similarity")).where(F.col("similarity") >= threshold)


def near_duplicates(pages: DataFrame, key: str = "page_id", text: str = "body_text", url: str = "final_url", mode: str = "fast", threshold: float = THRESHOLD) -> DataFrame:
    """One row per page in a cluster of two or more: ``key, url, cluster_id, cluster_size, representative_url, similarity``.

    The representative has the most tokens, of equals the least URL. Pages without text or
    with fewer than 50 tokens take no part.
    """
    signed = staged(signatures(pages, key, text, mode).withColumn("sid", F.xxhash64("sig")), "signatures")
    unique = staged(signed.groupBy("sid").agg(F.first("sig").alias("sig"), F.count(F.lit(1)).alias("n")), "unique-signatures")
    pairs = staged(similar_signatures(unique, threshold=threshold), "similar")
    comp = connected_components(pairs)
    labelled = signed.join(comp.withColumnRenamed("id", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid")).join(pages.select(key, F.col(url).alias("url")), key)
    best = F.min_by(F.struct(F.col("url"), F.col("sig")), F.struct((-F.col("n_tokens")).alias("t"), "url"))
    groups = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("cluster_size"), F.min(key).alias("cluster_id"), best.alias("rep")).where("cluster_size > 1")
    agree = F.size(F.filter(F.zip_with("sig", "rep.sig", lambda x, y: x == y), lambda v: v)) / F.size("sig")
    return labelled.join(groups, "component").select(key, "url", "cluster_id", "cluster_size", F.col("rep.url").alias("representative_url"), F.when(F.col("url") == F.col("rep.url"), F.lit(1.0)).otherwise(agree).alias("similarity"))
