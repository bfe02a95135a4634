"""Language identification by fusing evidence in a Bayesian posterior.

Evidence of a text: the likelihood of its letter trigrams, the language its page declares in the markup, the suffix of
its address, and a prior of its host. Host priors are smoothed towards the domain's and these towards the whole
collection's; all counts are grouped sums of the posteriors that the text alone gives.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import draw
from .store import written

#: Labelled documents of a language that the trigram model is fitted on, on average at most; an id's digest decides which.
SAMPLE_PER_LANGUAGE = 1000

#: Trigrams are counted in so many slots.
SLOTS = 1 << 15

#: A text counts as evidence like so many independent trigrams at most.
EVIDENCE = 50

#: Pseudo-counts: trigrams of a slot, rows of a declared language or suffix, rows a domain or host takes from the level above.
SLOT_COUNT, FACTOR_COUNT, PRIOR_COUNT = 0.5, 1.0, 20.0

#: Prior share of texts in no known language; their trigrams are uniform.
UNKNOWN, UNKNOWN_SHARE = "und", 1e-3

#: Posterior from which on a language is accepted.
ACCEPTED = 0.5


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


def trigram_slots(text: str | None) -> np.ndarray:
    """Slots of the letter trigrams of a text in lower case; everything that is no letter parts words."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    letter = _letters()[codes.astype(np.int64)]
    if not letter.any():
        return np.empty(0, np.int64)
    codes = np.where(letter, codes, np.uint64(32))
    kept = letter | np.concatenate(([False], letter[:-1]))
    codes = np.concatenate(([np.uint64(32)], codes[kept], [np.uint64(32)]))
    mixed = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % SLOTS


def fit_trigrams(labelled: DataFrame, languages: Sequence[str], per_language: int = SAMPLE_PER_LANGUAGE) -> np.ndarray:
    """Log probability of each slot in each language, from a bounded sample of rows (doc_id, text, lang).

    Only this model is fitted on a sample; it is SLOTS numbers a language, whatever the table holds.
    """
    rows = labelled.filter(F.col("lang").isin(list(languages)) & (F.length("text") > 0) & F.col("doc_id").isNotNull())
    chosen = F.lit(False)
    for row in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a language
        chosen = chosen | ((F.col("lang") == row["lang"]) & (draw(F.col("doc_id"), 9) * row["n"] <= per_language))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {x: np.zeros(SLOTS) for x in languages}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang")):
                sums[lang.as_py()] += np.bincount(trigram_slots(text.as_py()), minlength=SLOTS)
        for lang, values in sums.items():
            at = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(values[at])], names=["lang", "slot", "n"])

    counts = rows.filter(chosen).select("text", "lang").mapInArrow(counted, "lang string, slot bigint, n double")
    table = np.full((len(languages), SLOTS), SLOT_COUNT)
    for row in counts.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toLocalIterator():
        table[list(languages).index(row["lang"]), row["slot"]] += row["n"]
    return np.log(table / table.sum(axis=1, keepdims=True))


def text_likelihoods(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """Add ``trigrams`` (their number) and ``likelihood`` (log, of every language and of none) to rows with a text."""
    shared = docs.sparkSession.sparkContext.broadcast(np.vstack([model, np.full((1, SLOTS), -np.log(SLOTS))]).T.copy())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, values = [], []
            for text in batch.column("text"):
                slots = trigram_slots(text.as_py())
                total = sum((shared.value[slots[i : i + 65536]].sum(axis=0) for i in range(0, len(slots), 65536)), np.zeros(shared.value.shape[1]))
                numbers.append(len(slots))
                values.append((total * min(1.0, EVIDENCE / max(len(slots), 1))).tolist())
            kept = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(numbers, pa.int64()), pa.array(values, pa.list_(pa.float64()))],
                names=[*(batch.schema.names[i] for i in kept), "trigrams", "likelihood"],
            )

    kept = ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes if name != "text")
    return docs.mapInArrow(scored, f"{kept}, trigrams bigint, likelihood array<double>")


def page_evidence(pages: DataFrame) -> DataFrame:
    """(of, declared, host) of each document that has a page: its id is the last number in the path of the address.

    Of several pages of a document the one with the smallest page_id counts.
    """
    path = r"^[^?#]*/(\d{1,18})(?:\.\w+)?/?(?:[?#].*)?$"
    found = pages.select(
        F.expr(rf"try_cast(nullif(regexp_extract(url, '{path}', 1), '') AS bigint)".replace("\\", "\\\\")).alias("of"), "page_id",
        F.lower(F.nullif(F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1), F.lit(""))).alias("declared"),
        F.lower(F.nullif(F.regexp_extract("url", r"^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit(""))).alias("host"),
    )
    best = found.filter("of IS NOT NULL").groupBy("of").agg(F.min_by(F.struct("declared", "host"), "page_id").alias("page"))
    return best.select("of", "page.declared", "page.host")


def _shares(logs: np.ndarray) -> np.ndarray:
    weights = np.exp(logs - logs.max(axis=1, keepdims=True))
    return weights / weights.sum(axis=1, keepdims=True)


def _rows(column: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Array cells as a matrix, null cells as zeros, and which are there."""
    there = column.notna().to_numpy()
    values = np.zeros((len(column), width))
    if there.any():
        values[there] = np.stack(column[there].to_numpy())
    return values, there


def fuse(start: np.ndarray, likelihood: pd.Series, own: pd.Series, total: pd.Series, counts: dict[str, pd.Series], values: dict[str, pd.Series]) -> np.ndarray:
    """Posteriors of rows: smoothed priors of collection, domain and host, times the factors of text, declaration and suffix.

    ``counts`` are the sums of text posteriors over the rows with the same domain, host, declared language and suffix. What a
    row has added to them itself is taken off first.
    """
    width = len(start)
    log_text, mine = _rows(likelihood, width)[0], _rows(own, width)[0]
    everything = np.maximum(_rows(total, width)[0] - mine, 0)
    prior = (everything + PRIOR_COUNT * start) / (everything.sum(axis=1, keepdims=True) + PRIOR_COUNT)
    others = {}
    for key, column in counts.items():
        held, there = _rows(column, width)
        others[key] = np.maximum(held - mine, 0) * there[:, None], there
    for key in ("domain", "host"):
        held = others[key][0]
        prior = (held + PRIOR_COUNT * prior) / (held.sum(axis=1, keepdims=True) + PRIOR_COUNT)
    logs = np.log(prior) + log_text
    for key in ("declared", "suffix"):
        held, there = others[key]
        share = (held + FACTOR_COUNT) / (everything + FACTOR_COUNT * (values[key].to_numpy(float)[:, None] + 1))
        logs += np.where(there[:, None], np.log(share), 0)
    return _shares(logs)


def identify(evidence: DataFrame, languages: Sequence[str], accepted: float = ACCEPTED) -> DataFrame:
    """Fuse the evidence of rows (trigrams, likelihood, declared, host, ...) to (..., identified, confidence, accepted).

    Evidence that is null counts for nothing. A text without letters is ``und`` and never accepted.
    """
    names = np.array([*languages, UNKNOWN])
    start = np.array([(1 - UNKNOWN_SHARE) / len(languages)] * len(languages) + [UNKNOWN_SHARE])

    @F.pandas_udf("array<double>")
    def alone(likelihood: pd.Series, trigrams: pd.Series) -> pd.Series:
        shares = _shares(_rows(likelihood, len(start))[0] + np.log(start)) * (trigrams.to_numpy() > 0)[:, None]
        return pd.Series(list(shares))

    @F.pandas_udf("identified string, confidence double")
    def judged(likelihood: pd.Series, own: pd.Series, total: pd.Series, domain: pd.Series, host: pd.Series, declared: pd.Series, suffix: pd.Series, n_declared: pd.Series, n_suffix: pd.Series) -> pd.DataFrame:
        chances = fuse(
            start, likelihood, own, total, {"domain": domain, "host": host, "declared": declared, "suffix": suffix}, {"declared": n_declared, "suffix": n_suffix}
        )
        return pd.DataFrame({"identified": names[chances.argmax(axis=1)], "confidence": chances.max(axis=1)})

    rows = evidence.withColumn("domain", F.coalesce(F.nullif(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), F.lit("")), F.col("host")))
    rows = rows.withColumn("suffix", F.nullif(F.regexp_extract("host", r"\.([^.]+)$", 1), F.lit("")))
    rows = written(rows.withColumn("own", alone("likelihood", "trigrams")), "evidence")
    summed = F.array(*[F.sum(F.col("own")[i]) for i in range(len(start))])
    joined = rows.crossJoin(F.broadcast(rows.agg(  # one row
        summed.alias("all"), F.count_distinct("declared").alias("n_declared"), F.count_distinct("suffix").alias("n_suffix")
    )))
    for key in ("domain", "host", "declared", "suffix"):
        sums = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"{key}_key")).agg(summed.alias(f"{key}_sums"))
        joined = joined.join(sums, F.col(key) == F.col(f"{key}_key"), "left")
    joined = joined.withColumn("best", judged("likelihood", "own", "all", "domain_sums", "host_sums", "declared_sums", "suffix_sums", "n_declared", "n_suffix"))
    known = (F.col("best.identified") != UNKNOWN) & (F.col("best.confidence") >= accepted) & (F.col("trigrams") > 0)
    return joined.select(
        *evidence.columns, F.when(F.col("trigrams") > 0, F.col("best.identified")).otherwise(UNKNOWN).alias("identified"), F.col("best.confidence").alias("confidence"), known.alias("accepted"),
    )


def identify_documents(docs: DataFrame, pages: DataFrame, languages: Sequence[str] = ("de", "en", "es", "fr")) -> DataFrame:
    """(doc_id, digest, trigrams, identified, confidence, accepted), a row for every document.

    The trigram model is fitted on labelled documents (``lang``), at most ``SAMPLE_PER_LANGUAGE`` a language; ``lang`` is used
    for nothing else. A document's page gives declared language and host, without a page its source is the host.
    Null and empty texts, and those without letters, are ``und`` and not accepted; nulls in other columns are
    missing evidence; repeated rows are judged each; an empty table gives none.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("digest"), text.alias("text"))
    model = fit_trigrams(docs.select("doc_id", text.alias("text"), "lang"), languages)
    scored = text_likelihoods(rows, model)
    joined = scored.join(page_evidence(pages), F.col("doc_id") == F.col("of"), "left")
    joined = joined.select("doc_id", "digest", "trigrams", "likelihood", "declared", F.coalesce("host", "source").alias("host"))
    return identify(joined, languages).select("doc_id", "digest", "trigrams", "identified", "confidence", "accepted")


def in_known_language(docs: DataFrame, pages: DataFrame, languages: Sequence[str] = ("de", "en", "es", "fr")) -> DataFrame:
    """The documents whose language is accepted, with the columns of ``docs``."""
    judged = identify_documents(docs, pages, languages)
    rejected = written(judged.filter("NOT accepted").select(F.col("doc_id").alias("gone"), F.col("digest").alias("gone_digest")).distinct(), "rejected")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("own"), F.xxhash64(F.col("text").cast("string")).alias("digest"))
    same = F.col("own").eqNullSafe(F.col("gone")) & (F.col("digest") == F.col("gone_digest"))
    return rows.join(rejected, same, "left_anti").select("row.*")
