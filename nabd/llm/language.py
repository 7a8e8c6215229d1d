"""Language identification by Bayesian fusion of evidence.

Four pieces of evidence meet in log odds: the likelihood of the page's visible text under letter
n-gram models, the language its markup declares, the suffix of its address, and a prior of its host.
The likelihoods of declarations and suffixes and the priors are counts of text posteriors, summed
by grouped aggregation over all pages; the prior of a host is smoothed by its domain's, that by the
global one, and a page's own share is taken out of the counts it is judged by.

The letter models are fitted on `training_rows` documents with a language at most, chosen by a
seeded hash, with `grams` n-grams at most. Both numbers are shared evenly: languages take turns, so
a language with few documents brings them all, and each has its own most frequent n-grams. Everything
else covers all pages. As neighbouring n-grams are not independent, `temper` of them count as one, and
the text of a long page counts as much as one of `most_grams`, whose mean it is: all are read.

A null or empty page has no text evidence and adds nothing to the counts; a null or unreadable
address has the global prior; an undeclared language is a value of its own. Ties go to the first
language in code-point order. Repeated rows are judged alike. Without training documents the
language is null. Extra columns are ignored; empty tables give empty results.
"""

import html
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nabd.llm.common import slices
from nabd.plans.staging import stage

TRAINING_ROWS = 4_000
GRAMS = 60_000
UNSEEN = 0.02
SALTS = 64
SEED = 11
TEMPER, MOST_GRAMS = 5.0, 500
HOST_WEIGHT, PLAIN_WEIGHT = 4.0, 1.0

_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
_WORD = re.compile(r"[^\W\d_]+")


def visible_text(page: str | None) -> str:
    return html.unescape(_HIDDEN.sub(" ", page or ""))


def grams_of(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1)]


class LetterModel:
    """Log likelihoods of n-grams in each language.

    A part `UNSEEN` of every language's weight lies evenly on all n-grams, so that one which no
    language has speaks for none, however few documents a language was learned from.
    """

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.langs = sorted({lang for lang, _ in counts})
        place = {lang: i for i, lang in enumerate(self.langs)}
        table: dict[str, np.ndarray] = {}
        for (lang, gram), n in counts.items():
            table.setdefault(gram, np.zeros(len(place)))[place[lang]] = n
        total = sum(table.values(), np.zeros(len(place)))
        even = UNSEEN / (len(table) + 1)
        self.table = {g: np.log((1 - UNSEEN) * c / total + even) for g, c in table.items()}
        self.unseen = np.full(len(place), np.log(even))
        self.words: dict[str, tuple[int, np.ndarray]] = {}

    def likelihood(self, text: str) -> tuple[int, np.ndarray]:
        """Number of grams, and the mean log likelihood of a gram in each language."""
        n, total = 0, np.zeros(len(self.langs))
        if len(self.words) > 300_000:
            self.words.clear()
        for word, times in Counter(_WORD.findall(text.lower())).items():
            if word not in self.words:
                grams = grams_of(word)
                self.words[word] = len(grams), sum((self.table.get(g, self.unseen) for g in grams), np.zeros(len(self.langs)))
            count, value = self.words[word]
            n += count * times
            total += value * times
        return n, total / n if n else total


def _in_turn(rows: DataFrame, order: list[Column | str], most: int) -> DataFrame:
    """`most` rows: the first of each language by `order`, then the second of each, and so on."""

    def first(rows: DataFrame, *keys: Column | str) -> DataFrame:
        turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return rows.withColumn("turn", turn).filter(F.col("turn") <= most)

    # A frequent language is cut in parts first, so that one task ranks SALTS * most rows at most.
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))
    parts = first(rows, "lang", salt)
    return first(parts, "lang").orderBy("turn", "lang").limit(most)


def fit(documents: DataFrame, training_rows: int = TRAINING_ROWS, grams: int = GRAMS) -> LetterModel:
    """Letter models from a bounded sample of documents that name their language."""
    named = documents.filter("lang is not null and doc_id is not null").select("doc_id", "lang")
    chosen = _in_turn(named, [F.xxhash64(F.lit(SEED), "doc_id"), "doc_id"], training_rows)
    chosen = chosen.select("doc_id").distinct()
    # At most training_rows numbers: a broadcast of proven size.
    rows = documents.filter("lang is not null and text is not null").join(F.broadcast(chosen), "doc_id")

    def count(batches):
        for batch in slices(batches):
            found: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for word, times in Counter(_WORD.findall(text.lower())).items():
                    for gram in grams_of(word):
                        found[lang, gram] += times
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in found], pa.string()),
                    pa.array([k[1] for k in found], pa.string()),
                    pa.array(list(found.values()), pa.int64()),
                ],
                ["lang", "gram", "n"],
            )

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, gram string, n long")
    sums = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = _in_turn(sums, [F.desc("n"), "gram"], grams).collect()
    return LetterModel({(r["lang"], r["gram"]): r["n"] for r in top})


def evidence(
    pages: DataFrame, model: LetterModel, temper: float = TEMPER, most_grams: int = MOST_GRAMS
) -> DataFrame:
    """page_id, host, domain, suffix, declared, and the text's tempered log likelihoods."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1))
    rows = pages.select(
        "page_id",
        host.alias("host"),
        F.substring_index(host, ".", -2).alias("domain"),
        F.coalesce(F.substring_index(host, ".", -1), F.lit("")).alias("suffix"),
        F.coalesce(declared, F.lit("")).alias("declared"),
        "html",
    )

    def likelihoods(batches):
        own = LetterModel({})
        own.__dict__.update(model.__dict__ | {"words": {}})
        for batch in slices(batches, 64):
            counts, values = [], []
            for page in batch.column("html").to_pylist():
                n, mean = own.likelihood(visible_text(page))
                counts.append(n)
                values.append((mean * min(n, most_grams) / temper).tolist())
            arrays = [batch.column(c) for c in batch.schema.names if c != "html"]
            names = [c for c in batch.schema.names if c != "html"]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(counts, pa.int64()), pa.array(values, pa.list_(pa.float64()))],
                [*names, "n_grams", "text_ll"],
            )

    id_type = dict(pages.dtypes)["page_id"]
    return rows.mapInArrow(
        likelihoods,
        f"page_id {id_type}, host string, domain string, suffix string, declared string, n_grams long, "
        "text_ll array<double>",
    )


def _softmax(ll: list[Column]) -> list[Column]:
    top = F.greatest(*ll) if len(ll) > 1 else ll[0]
    parts = [F.exp(x - top) for x in ll]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def identify(
    pages: DataFrame,
    documents: DataFrame,
    model: LetterModel | None = None,
    temper: float = TEMPER,
    most_grams: int = MOST_GRAMS,
) -> DataFrame:
    """page_id, lang, score (its posterior), text_lang, declared, suffix and host of every page."""
    model = model or fit(documents)
    langs = model.langs
    if not langs:
        null = F.lit(None).cast("string")
        found = evidence(pages, model, temper, most_grams)
        return found.select(
            "page_id", null.alias("lang"), F.lit(None).cast("double").alias("score"),
            null.alias("text_lang"), "declared", "suffix", "host",
        )
    each = range(len(langs))
    found = evidence(pages, model, temper, most_grams)
    text = _softmax([F.col("text_ll")[i] for i in each])
    told = F.col("n_grams") > 0
    found = stage(
        found.withColumns({f"p{i}": F.when(told, text[i]).otherwise(0.0) for i in each}), "evidence"
    )
    sums = [F.sum(f"p{i}") for i in each]

    def counted(key: str) -> DataFrame:
        return found.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array(*sums).alias(f"{key}_n"))

    all_of = found.agg(*sums).first()
    every = [float(x or 0.0) for x in all_of]
    total = sum(every)
    values = found.agg(F.count_distinct("declared"), F.count_distinct("suffix")).first()
    rows = found
    for key in ("host", "domain", "suffix", "declared"):
        rows = rows.join(counted(key), key, "left")

    def own(key: str, i: int) -> Column:
        return F.greatest(F.coalesce(F.col(f"{key}_n")[i], F.lit(0.0)) - F.col(f"p{i}"), F.lit(0.0))

    def smoothed(key: str, i: int, wider: Column) -> Column:
        size = sum((own(key, j) for j in each), F.lit(0.0))
        return (own(key, i) + HOST_WEIGHT * wider) / (size + HOST_WEIGHT)

    posterior = []
    for i in each:
        prior = F.lit((every[i] + PLAIN_WEIGHT) / (total + PLAIN_WEIGHT * len(langs)))
        prior = smoothed("host", i, smoothed("domain", i, prior))
        seen = F.lit(every[i]) - F.col(f"p{i}")
        parts = [
            F.log((own(key, i) + PLAIN_WEIGHT) / (seen + PLAIN_WEIGHT * (kinds + 1)))
            for key, kinds in (("declared", values[0]), ("suffix", values[1]))
        ]
        posterior.append(F.col("text_ll")[i] + F.log(prior) + parts[0] + parts[1])

    def best(scores: list[Column]) -> Column:
        top = F.greatest(*scores) if len(scores) > 1 else scores[0]
        return F.coalesce(*[F.when(s >= top, F.lit(lang)) for s, lang in zip(scores, langs, strict=True)])

    rows = rows.withColumns({f"z{i}": z for i, z in enumerate(posterior)})
    z = [F.col(f"z{i}") for i in each]
    share = _softmax(z)
    return rows.select(
        "page_id",
        best(z).alias("lang"),
        (F.greatest(*share) if len(langs) > 1 else share[0]).alias("score"),
        F.when(told, best([F.col("text_ll")[i] for i in each])).alias("text_lang"),
        "declared",
        "suffix",
        "host",
    )
