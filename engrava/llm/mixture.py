"""Mixing sources to target weights: entropy balancing of document rates, rounded into copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrava.session import materialise

#: Folder of the public tokenizer's vocabulary files; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"


def token_counts(documents: DataFrame, *, folder: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``doc_id``, ``source`` and ``tokens`` of the whole text, in tokens of a public byte-level BPE vocabulary; null text has none."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        with open(f"{folder}/{vocabulary}") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, lines)}
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        coder = tiktoken.Encoding("mixture", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": [len(coder.encode_ordinary(t)) if t else 0 for t in pdf["text"]]})

    return documents.select("doc_id", "source", "text").mapInPandas(count, "doc_id bigint, source string, tokens bigint")


def _uniform(seed: int):
    """A number in [0, 1) of each document, the same in every run."""
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def balance(counted: DataFrame, targets: DataFrame, *, total: int | None = None, rounds: int = 40, tolerance: float = 1e-6) -> DataFrame:
    """Entropy-balanced rates: for each source the multiplier of the exponential tilt that meets its token constraint.

    The rates w of a source's documents are the ones closest in entropy to keeping each document once that give the source its
    target share of ``total`` tokens (default: all tokens of the targeted sources) with 0 <= w <= max_repeats. The dual is convex;
    its solution is w = min(max_repeats, exp(lambda * tokens / mean tokens)) with one lambda for each source, found by Newton steps
    whose gradients and curvatures are sums over all documents, by source, in one aggregation a round. Sources that cannot reach
    their target at the cap are given whole at the cap. ``targets`` is a fixed list; the result has one row for each target:
    ``source``, ``target_share``, ``max_repeats``, ``lam``, ``mean_tokens``, ``need``, ``supply``, ``reachable``.
    """
    spark = counted.sparkSession
    goal = targets.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))).alias("max_repeats"))
    supply = counted.join(F.broadcast(goal.select("source")), "source").groupBy("source").agg(F.sum("tokens").alias("supply"), F.avg("tokens").alias("mean_tokens"))
    table = goal.join(supply, "source", "left").toPandas().fillna({"supply": 0.0, "mean_tokens": 1.0})
    if table.empty:
        return spark.createDataFrame([], "source string, target_share double, max_repeats int, lam double, mean_tokens double, need double, supply double, reachable boolean")
    table["mean_tokens"] = table["mean_tokens"].clip(lower=1e-9)
    size = float(total if total is not None else table["supply"].sum())
    table["need"] = table["target_share"] * size
    table["reachable"] = table["need"] <= table["supply"] * table["max_repeats"] * (1 - 1e-9)
    # start from the rate that all documents of the source would share
    table["lam"] = np.log(np.clip(table["need"] / np.maximum(table["supply"], 1e-9), 1e-6, table["max_repeats"]))
    table.loc[~table["reachable"], "lam"] = 1e6
    low, high = np.full(len(table), -60.0), np.full(len(table), 60.0)
    for _ in range(rounds):
        # what needs nothing has nothing to solve
        open_rows = (table["reachable"] & (table["need"] > 0)).to_numpy()
        if not open_rows.any():
            break
        at = spark.createDataFrame(table.loc[open_rows, ["source", "lam", "mean_tokens", "max_repeats"]])
        x = F.col("tokens") / F.col("mean_tokens")
        raw = F.exp(F.least(F.col("lam") * x, F.lit(60.0)))
        free = raw < F.col("max_repeats")
        sums = counted.join(F.broadcast(at), "source").groupBy("source").agg(F.sum(F.least(raw, F.col("max_repeats")) * F.col("tokens")).alias("given"), F.sum(F.when(free, raw * x * F.col("tokens")).otherwise(0.0)).alias("slope")).toPandas()
        merged = table.merge(sums, on="source", how="left")
        gap = (merged["need"] - merged["given"]).to_numpy()
        if np.max(np.abs(gap[open_rows]) / merged["need"].to_numpy()[open_rows]) < tolerance:
            break
        lam = table["lam"].to_numpy()
        low, high = np.where(gap > 0, np.maximum(low, lam), low), np.where(gap < 0, np.minimum(high, lam), high)
        step = lam + gap / np.maximum(merged["slope"].to_numpy(), 1e-12)
        # a Newton step that leaves the bracket is replaced by its middle
        step = np.where((step <= low) | (step >= high), (low + high) / 2, step)
        table["lam"] = np.where(open_rows, step, lam)
    return spark.createDataFrame(table[["source", "target_share", "max_repeats", "lam", "mean_tokens", "need", "supply", "reachable"]].astype({"supply": float, "max_repeats": int}))


def mix(documents: DataFrame, targets: DataFrame, *, total: int | None = None, seed: int = 17, folder: str = TOKENIZERS) -> DataFrame:
    """The mixture: ``doc_id``, ``source``, ``tokens`` and ``copies`` of each document that occurs in it.

    Rates of ``balance`` become whole copies: the whole part of the rate, and one more with the probability of its fraction, decided
    by a hash of the document. ``corrected`` then takes back the rounding error of each source, so its tokens stay within a few
    documents of its constraint, and no document exceeds ``max_repeats``. Sources without a target and documents with null source
    or without text take no part; an empty table gives an empty result; ``doc_id`` must be unique.
    """
    counted = materialise(token_counts(documents, folder=folder), "tokens")
    plan = F.broadcast(balance(counted, targets, total=total))
    rated = counted.join(plan, "source").where("tokens > 0")
    rate = F.least(F.exp(F.least(F.col("lam") * F.col("tokens") / F.col("mean_tokens"), F.lit(60.0))), F.col("max_repeats").cast("double"))
    copies = F.floor(F.col("rate")) + (_uniform(seed) < F.col("rate") - F.floor("rate")).cast("int")
    drawn = materialise(rated.withColumn("rate", rate).withColumn("copies", F.least(copies, F.col("max_repeats").cast("bigint"))).select("doc_id", "source", "tokens", "max_repeats", "need", "reachable", "rate", "copies"), "drawn")
    return corrected(drawn, seed).where("copies > 0").select("doc_id", "source", "tokens", F.col("copies").cast("bigint").alias("copies"))


def corrected(drawn: DataFrame, seed: int) -> DataFrame:
    """Undo the rounding error of each source: documents in a fixed random order take or give one copy until the tokens fit.

    The threshold of that order is found by a histogram of 4,096 hash strata, so no source is sorted or gathered.
    """
    lack = drawn.groupBy("source").agg((F.max("need") - F.sum(F.col("copies") * F.col("tokens"))).alias("lack"))
    order = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(4096)).cast("int")
    wanting = drawn.join(F.broadcast(lack), "source").withColumn("stratum", order)
    fits = F.col("reachable") & F.when(F.col("lack") > 0, F.col("copies") < F.least(F.ceil("rate"), F.col("max_repeats"))).otherwise(F.col("copies") > F.floor("rate"))
    hist = wanting.where(fits).groupBy("source", "stratum").agg(F.sum("tokens").alias("t"), F.max("lack").alias("lack")).toPandas().sort_values(["source", "stratum"])
    edges = []
    for source, h in hist.groupby("source"):
        run = h["t"].cumsum().to_numpy()
        edges.append((source, int(h["stratum"].to_numpy()[np.searchsorted(run, abs(h["lack"].iloc[0]))]) if run[-1] > abs(h["lack"].iloc[0]) else 4096))
    if not edges:
        return drawn
    edge = drawn.sparkSession.createDataFrame(edges, "source string, edge int")
    step = F.when(fits & (F.col("stratum") < F.coalesce("edge", F.lit(0))), F.when(F.col("lack") > 0, 1).otherwise(-1)).otherwise(0)
    return wanting.join(F.broadcast(edge), "source", "left").withColumn("copies", F.col("copies") + step)


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """What the mixture reached: one row for each target with its tokens, documents, largest repeat and actual share."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("n_documents"), F.max("copies").alias("most_copies"))
    whole = got.agg(F.sum("tokens").alias("all_tokens"))
    out = targets.join(got, "source", "left").crossJoin(F.broadcast(whole))
    return out.select(
        "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
    )
