"""Language of web pages by Bayesian fusion of evidence.

Four sources are multiplied for each language: the likelihood of the main text
under character n-grams, that of the language which the markup declares, that of
one named in the address' path, and a prior of the page's host.  The prior is
smoothed toward that of the address' suffix, and that toward the whole table's;
both are grouped sums of the other pages' text posteriors.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .html_text import blocks, host

#: About so many labelled documents of each language (those whose hashes are lowest) the text model is fitted on, and n-grams of each that it keeps at most.
ROWS, GRAMS = 1_000, 12_000
#: N-grams that unseen ones are smoothed over.
SPACE = 30_000
#: N-grams of a text beyond which its likelihood counts no more in total: neighbours aren't independent.
WEIGHT = 200
#: Pages that a prior counts for.
HOST, SUFFIX, GLOBAL = 5.0, 20.0, 1.0
#: Pseudo-counts of what markup and paths declare.
SMOOTH = 1.0

_WORDS = re.compile(r"[^\W\d_]+")
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-zA-Z]{2,3})\b", re.I)
_PATH = re.compile(r"//[^/?#]+/([a-zA-Z]{2})(?=[/?#]|$)")


def grams(word: str) -> list[str]:
    """A word's n-grams of one to four characters, with its ends marked."""
    text = f" {word} "
    return [text[i : i + n] for n in (2, 3, 4) for i in range(len(text) - n + 1)] + list(word)


class Model:
    """Log-likelihoods of n-grams: what each language that has one adds to ``unseen``, which is the same for all."""

    def __init__(self, languages: list[str], logs: dict[str, list[tuple[int, float]]], unseen: float):
        self.languages, self.logs, self.unseen, self.memo = languages, logs, unseen, {}

    def _word(self, word: str) -> tuple[int, np.ndarray]:
        own = grams(word)
        total = [self.unseen * len(own)] * len(self.languages)
        for g in own:
            for k, more in self.logs.get(g, ()):
                total[k] += more
        return len(own), np.array(total)

    def likelihood(self, text: str) -> list[float]:
        """The text's log-likelihood, scaled to at most WEIGHT n-grams, less its largest."""
        total, n = np.zeros(len(self.languages)), 0
        for word, k in Counter(_WORDS.findall(text.lower())).items():
            if (own := self.memo.get(word)) is None:
                if len(self.memo) * len(self.languages) > 800_000:
                    self.memo.clear()
                own = self.memo[word] = self._word(word)
            n += k * own[0]
            total += k * own[1]
        if n > WEIGHT:
            total *= WEIGHT / n
        return (total - total.max()).tolist()


def train(docs: DataFrame, rows: int = ROWS, most: int | None = None) -> Model:
    """The text model, from whole texts of about ``rows`` documents of each language, or all it has, and its ``most`` frequent n-grams."""
    most = most or GRAMS
    own = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select(F.lower(F.col("lang").cast("string")).alias("lang"), "doc_id", F.col("text").cast("string").alias("text"))
    sizes = own.groupBy("lang").agg(F.count("*").alias("size"))
    # a bound for the hash, not a rank: no language is gathered in one task
    place = (F.xxhash64("doc_id", "text") / F.lit(2.0**64) + 0.5) * F.col("size")
    texts = own.join(F.broadcast(sizes), "lang").where((F.col("size") <= rows) | (place < rows)).select("lang", "text")  # a row a language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter[str]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words.setdefault(lang, Counter()).update(_WORDS.findall(text.as_py().lower()))
        for lang, found in words.items():
            total: Counter[str] = Counter()
            for word, n in found.items():
                for g in grams(word):
                    total[g] += n
            yield pa.record_batch([pa.array([lang] * len(total), pa.string()), pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["lang", "gram", "n"])

    counts = table(texts.mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    known = counts.groupBy("lang").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(known["lang"])
    if not languages:
        return Model(["und"], {}, 0.0)
    # the least count of each language that at most ``most`` of its n-grams reach
    least: dict[str, int] = {}
    for lang, found in counts.groupBy("lang", "n").agg(F.count("*").alias("grams")).toPandas().groupby("lang"):
        found = found.sort_values("n", ascending=False)
        fits = found["n"][found["grams"].cumsum() <= most]
        least[lang] = int(fits.min() if len(fits) else found["n"].max())
    bounds = docs.sparkSession.createDataFrame(sorted(least.items()), "lang string, least bigint")
    chosen = counts.join(F.broadcast(bounds), "lang").where("n >= least").select("gram").distinct()
    found = counts.join(chosen, "gram", "left_semi").select("lang", "gram", "n").toPandas()
    totals, at = dict(zip(known["lang"], known["n"])), {x: k for k, x in enumerate(languages)}
    # one floor for all: what no language has seen must not speak for the one with the fewest texts
    unseen = float(np.log(0.5 / (max(totals.values()) + 0.5 * SPACE)))
    logs: dict[str, list[tuple[int, float]]] = {}
    for lang, gram, n in found.itertuples(index=False):
        logs.setdefault(gram, []).append((at[lang], float(np.log((n + 0.5) / (totals[lang] + 0.5 * SPACE))) - unseen))
    return Model(languages, logs, unseen)


def evidence(pages: DataFrame, model: Model) -> DataFrame:
    """``page_id, host, suffix, declared, named, text``: what each page shows; text is a log-likelihood by language."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known = set(own.languages)
        code = lambda m: (c if (c := m[1].lower()) in known else "other") if m else "none"
        for batch in batches:
            out: list[tuple] = []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2)):
                page, name = page.as_py() or "", host(url)
                found = blocks(page)
                text = [x for x, kind in found if kind == 0] or [x for x, kind in found if kind == 2]
                out.append((name, name.rpartition(".")[2], code(_DECLARED.search(page)), code(_PATH.search(url or "")), own.likelihood("\n".join(text))))
            kinds = [pa.string()] * 4 + [pa.list_(pa.float64())]
            columns = zip(*out) if out else [()] * 5
            yield pa.record_batch([batch.column(0), *(pa.array(list(c), kind) for c, kind in zip(columns, kinds))], names=["page_id", "host", "suffix", "declared", "named", "text"])

    ids = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, f"page_id {ids}, host string, suffix string, declared string, named string, text array<double>")


def _normal(logs: Column) -> Column:
    """Probabilities from logarithms."""
    top = F.transform(F.array(logs), lambda x: F.transform(x, lambda v: F.exp(v - F.array_max(x))))[0]
    return F.transform(F.array(top), lambda x: F.transform(x, lambda v: v / F.aggregate(x, F.lit(0.0), lambda a, b: a + b)))[0]


def _sums(column: str, n: int) -> list[Column]:
    return [F.sum(F.element_at(column, k + 1)).alias(f"{k}") for k in range(n)]


def _packed(df: DataFrame, key: str, name: str, n: int) -> DataFrame:
    return df.select(key, F.array(*(F.col(f"{k}") for k in range(n))).alias(name))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """``page_id, lang, score, text_lang, declared, host`` for every row of ``page_id, url, html``.

    ``score`` is the posterior of ``lang``, ties going to the first language by
    name.  Null and empty pages have no text evidence; pages without a host
    share one; without labelled documents the language is ``und``; rows of one
    id are pages of their own; very long pages are read whole; an empty table gives no rows; other columns are
    ignored.
    """
    model = train(docs)
    languages, n = model.languages, len(model.languages)
    each = table(evidence(pages, model), "evidence").withColumn("p", _normal(F.col("text")))
    # a page's own posterior is taken out of its host's and suffix' sums before they become its prior
    hosts = _packed(each.groupBy("host").agg(*_sums("p", n)), "host", "by_host", n)
    suffixes = _packed(each.groupBy("suffix").agg(*_sums("p", n)), "suffix", "by_suffix", n)
    whole = each.agg(*_sums("p", n)).first()
    everywhere = np.array([x or 0.0 for x in whole]) + GLOBAL
    everywhere /= everywhere.sum()

    def told(column: str) -> Column:
        """log P(what is declared | language), from how often text of the language declares it; at most languages + 2 values."""
        found = {r[column]: np.array([r[f"{k}"] for k in range(n)]) for r in each.groupBy(column).agg(*_sums("p", n)).collect()}
        total = sum(found.values(), np.zeros(n)) + SMOOTH * (n + 2)
        logs = {k: np.log((v + SMOOTH) / total) for k, v in found.items()}
        cases = [F.when(F.col(column) == k, F.array(*(F.lit(float(x)) for x in v))) for k, v in logs.items()]
        return F.coalesce(*cases, F.array(*[F.lit(0.0)] * n))

    # sums as tables of their own: adaptive plans split a hot host or suffix only between two plain shuffles
    joined = each.join(table(hosts, "hosts"), "host").join(table(suffixes, "suffixes"), "suffix")
    less = lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x - y, F.lit(0.0)))

    def smoothed(counts: Column, prior: Column, weight: float) -> Column:
        return F.transform(
            F.array(counts),
            lambda c: F.zip_with(c, prior, lambda x, q: (x + weight * q) / (F.aggregate(c, F.lit(0.0), lambda a, b: a + b) + weight)),
        )[0]

    base = F.array(*(F.lit(float(x)) for x in everywhere))
    joined = joined.withColumn("prior", smoothed(less(F.col("by_suffix"), F.col("p")), base, SUFFIX))
    joined = joined.withColumn("prior", smoothed(less(F.col("by_host"), F.col("p")), F.col("prior"), HOST))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = reduce(add, [F.col("text"), told("declared"), told("named"), F.transform("prior", lambda x: F.log(x))])
    joined = joined.withColumn("posterior", _normal(logs))
    names = F.array(*map(F.lit, languages))
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return joined.select("page_id", best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("score"), best(F.col("p")).alias("text_lang"), "declared", "host")
