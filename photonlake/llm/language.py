"""Language identification by Bayesian evidence fusion.

Evidence on a page's language: the likelihood of its letters under trigram models, the language that its
markup declares, the suffix of its address, and a prior of its host. Reliability tables of the declared
language and of the suffix, and the host priors, come from grouped aggregation of what the text alone says
over all pages; a host's counts, without the page's own, are smoothed towards its domain's and these
towards the corpus's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.llm import bytescan as B
from photonlake.llm.columns import let
from photonlake.llm.skew import with_groups
from photonlake.llm.storage import Scratch, bounded_batches

#: The answer where no letters speak and nothing is declared.
UNKNOWN = "und"
BITS = 16
#: Grams beyond this many add nothing to the certainty of a text.
CERTAIN = 60
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed trigram) of letters, other characters folded to one space."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = _FOLD[data].astype(np.uint32)
    code = x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]
    blank = x == 0x20
    use = ~((blank[:-2] & blank[1:-1]) | (blank[1:-1] & blank[2:]))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    use &= ~(edge[1:-2] | edge[2:-1])
    at = np.flatnonzero(use)
    return np.searchsorted(offsets, at, "right") - 1, (code[at] * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.int64)


class TextModel:
    """Log likelihood of hashed trigrams per language, smoothed by one half."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.log = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1])).T.astype(np.float32).copy()

    @staticmethod
    def fit(labelled: DataFrame, sample: int = 8000) -> TextModel:
        """From at most ``sample`` rows (text, lang, perhaps doc_id) in the order of a hash of id and text; null languages are passed over.

        The hashes are chosen first and alone; rows alike in all three share one.
        """
        rows = labelled.filter("lang is not null and text is not null")
        keyed = rows.select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64("text", "lang", *[c for c in ("doc_id",) if c in labelled.columns]).alias("key"))
        chosen = keyed.select("key").orderBy("key").limit(sample).distinct()
        rows = keyed.join(F.broadcast(chosen), "key", "left_semi").select("text", "lang")

        def run(batches):
            counts: dict[str, np.ndarray] = {}
            for batch in batches:
                lang = batch.column(1).to_pylist()
                for first, end, data, offsets in B.slices(batch.column(0), B.SHORT_SLICE_BYTES):
                    row, gram = grams(data, offsets)
                    names = np.array(lang[first:end])
                    for name in set(names):
                        counts.setdefault(name, np.zeros(1 << BITS, np.int64))
                        counts[name] += np.bincount(gram[names[row] == name], minlength=1 << BITS)
            for name, c in counts.items():
                some = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(c[some])], names=["lang", "gram", "n"])

        got = rows.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
        names = sorted(set(got.column("lang").to_pylist())) or [UNKNOWN]
        counts = np.zeros((len(names), 1 << BITS))
        if got.num_rows:
            at = np.searchsorted(names, got.column("lang").to_pylist())
            counts[at, got.column("gram").to_numpy()] = got.column("n").to_numpy()
        return TextModel(names, counts)

    def evidence(self, column: pa.Array) -> np.ndarray:
        """(rows, languages): log likelihoods, tempered to ``CERTAIN`` grams; without grams all 0."""
        out = []
        for first, end, data, offsets in B.slices(column, B.SHORT_SLICE_BYTES):
            row, gram = grams(data, offsets)
            n = np.bincount(row, minlength=end - first)
            total = np.stack([np.bincount(row, self.log[gram, k], minlength=end - first) for k in range(len(self.languages))], axis=1)
            out.append(total * (np.minimum(n, CERTAIN) / np.maximum(n, 1))[:, None])
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)))


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


class LanguageId:
    """Fuse evidence for rows (id, text, declared, suffix, domain, host); any of the last four may be null.

    Rows without letters rely on the other evidence; without any evidence the answer is ``und`` with the
    prior's probability. ``host_weight`` and ``domain_weight`` are the pseudo-counts of the smoothing.
    """

    def __init__(self, spark: SparkSession, model: TextModel, host_weight: float = 8.0, domain_weight: float = 20.0):
        self.spark, self.model, self.host_weight, self.domain_weight = spark, model, host_weight, domain_weight
        self.scratch = Scratch(spark, "language")
        bounded_batches(spark)

    def _text_evidence(self, rows: DataFrame) -> DataFrame:
        shared = self.spark.sparkContext.broadcast(self.model)

        def run(batches):
            for batch in batches:
                logs = shared.value.evidence(batch.column(1))
                offsets = pa.array(np.arange(len(logs) + 1, dtype=np.int32) * logs.shape[1])
                lists = pa.ListArray.from_arrays(offsets, pa.array(logs.ravel().astype(np.float64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], lists], names=["id", "declared", "suffix", "domain", "host", "logs"])

        return rows.select("id", F.coalesce("text", F.lit("")).alias("text"), "declared", "suffix", "domain", "host").mapInArrow(run, "id bigint, declared string, suffix string, domain string, host string, logs array<double>")

    def run(self, rows: DataFrame) -> DataFrame:
        """(id, lang, probability, text_lang, declared, host) of every row."""
        names = self.model.languages
        n = len(names)
        codes = F.array(*map(F.lit, names))
        seen = self._text_evidence(rows)
        flat = F.array_max("logs") == F.array_min("logs")
        seen = self.scratch.table(seen.withColumn("said", F.when(flat, F.array(*[F.lit(0.0)] * n)).otherwise(_softmax(F.col("logs")))), "evidence")
        sums = F.array(*[F.sum(F.col("said")[k]) for k in range(n)])

        def counts(*keys: str) -> DataFrame:
            return seen.groupBy(*keys).agg(sums.alias("c"))

        def smoothed(own: str, above: Column, weight: float) -> Column:
            total = F.aggregate(own, F.lit(0.0), lambda s, x: s + x)
            return F.zip_with(own, above, lambda x, p: (x + p * weight) / (total + weight))

        everything = counts().select(F.transform("c", lambda x: x + 1.0).alias("c"))
        total = F.aggregate("c", F.lit(0.0), lambda s, x: s + x)
        overall = everything.select(F.transform("c", lambda x: x / total).alias("p"))
        domains = counts("domain").crossJoin(F.broadcast(overall)).select("domain", smoothed("c", F.col("p"), self.domain_weight).alias("domain_p"))
        of_host = seen.groupBy("host", "domain").agg(sums.alias("c"), F.count("*").alias("rows")).select("host", F.col("domain").alias("d"), F.col("c").alias("host_c"), "rows")
        hosts = of_host.join(domains, F.col("d").eqNullSafe(domains.domain), "left").filter("host is not null")
        hosts = hosts.groupBy("host").agg(F.first("domain_p", ignorenulls=True).alias("domain_p"), F.array(*[F.sum(F.col("host_c")[k]) for k in range(n)]).alias("host_c"), F.sum("rows").alias("rows"))
        hosts = self.scratch.table(hosts, "hosts")
        known = F.when(F.array_contains(codes, F.lower("declared")), F.lower("declared")).otherwise("other")
        declared = self._reliability(seen.withColumn("sign", F.when(F.col("declared").isNotNull(), known)), n, "declared_p").withColumnRenamed("sign", "d_sign")
        suffixes = self.scratch.table(self._reliability(seen.withColumn("sign", F.col("suffix")), n, "suffix_p").withColumnRenamed("sign", "suffix"), "suffixes")
        total = seen.count()
        joined = seen.withColumn("d_sign", F.when(F.col("declared").isNotNull(), known)).join(F.broadcast(declared.drop("rows")), "d_sign", "left")
        joined = with_groups(joined, suffixes, "suffix", "rows", total, ["id"]).select(*joined.columns, "group.suffix_p")
        joined = with_groups(joined, hosts, "host", "rows", total, ["id"]).select(*joined.columns, "group.domain_p", "group.host_c").crossJoin(F.broadcast(overall))
        others = F.zip_with("host_c", "said", lambda c, s: F.greatest(c - s, F.lit(0.0)))
        prior = F.when(F.col("host_c").isNull(), F.col("p")).otherwise(smoothed(others, F.coalesce("domain_p", "p"), self.host_weight))
        logs = F.zip_with("logs", prior, lambda a, b: a + F.log(b))
        for sign in ("declared_p", "suffix_p"):
            logs = F.zip_with(logs, F.coalesce(sign, F.array(*[F.lit(1.0)] * n)), lambda a, b: a + F.log(b))
        fused = _softmax(logs)
        best = F.array_max("fused")
        silent = flat & F.col("declared").isNull() & F.col("host").isNull() & F.col("suffix").isNull()
        out = joined.withColumn("fused", fused)
        text_lang = F.when(flat, F.lit(UNKNOWN)).otherwise(F.element_at(codes, F.array_position("said", F.array_max("said")).cast("int")))
        return out.select("id", F.when(silent, F.lit(UNKNOWN)).otherwise(F.element_at(codes, F.array_position("fused", best).cast("int"))).alias("lang"), best.alias("probability"), text_lang.alias("text_lang"), "declared", "host")

    def _reliability(self, seen: DataFrame, n: int, name: str) -> DataFrame:
        """(sign, name, rows): probability of a sign given each language, smoothed by one over the number of signs, and how often it occurs."""
        by = seen.filter("sign is not null").groupBy("sign").agg(F.array(*[F.sum(F.col("said")[k]) for k in range(n)]).alias("c"), F.count("*").alias("rows"))
        totals = by.agg(F.count("*").alias("signs"), F.array(*[F.sum(F.col("c")[k]) for k in range(n)]).alias("t"))
        smoothed = F.zip_with("c", "t", lambda c, t: (c + 1.0 / F.col("signs")) / (t + 1.0))
        return by.crossJoin(F.broadcast(totals)).select("sign", smoothed.alias(name), "rows")


#: Second labels under which countries register names, as in co.uk.
SECOND_LABELS = ("ac", "co", "com", "edu", "go", "gob", "gov", "net", "or", "org")


def _without(html: Column, opener: str, closer: str, stray: str) -> Column:
    """The text without what lies between an opener and the next closer (patterns of bounded length); a closer without an opener becomes ``stray``.

    The text is split at the closers and each piece is looked at once, so the time grows with the length, whatever stays open.
    """

    def kept(piece: Column, i: Column, last: Column) -> Column:
        at = F.regexp_instr(piece, F.lit(opener))
        return F.when(i == last, piece).when(at > 0, F.concat(F.substring(piece, F.lit(1), at - 1), F.lit(" "))).otherwise(F.concat(piece, F.lit(stray)))

    def joined(pieces: Column) -> Column:
        return F.array_join(F.transform(pieces, lambda p, i: kept(p, i, F.size(pieces) - 1)), "")

    return let(F.split(html, closer), joined)


def page_rows(pages: DataFrame) -> DataFrame:
    """Text, declared language and address parts of raw pages.

    Comments, scripts, styles, tags and entities are no text. What is not closed stays; a tag ends at the next angle bracket, so
    that the time grows with the page's length. Null pages and addresses have none of these; a host without a dot has no suffix and is its own domain.
    """
    html = F.coalesce("html", F.lit(""))
    text = _without(html, "<!--", "-->", "-->")
    for name in ("script", "style"):
        text = _without(text, rf"(?i)<{name}\b", rf"(?i)</{name}>", " ")
    text = F.regexp_replace(text, r"<[^<>]*>|&[#\w]+;", " ")
    declared = F.lower(F.regexp_extract(html, r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    full = lambda c: F.when(c != "", c)
    rows = pages.select(F.col("page_id").cast("bigint").alias("id"), text.alias("text"), full(declared).alias("declared"), full(host).alias("host"))
    labels = F.split("host", r"\.")
    suffix = F.when(F.size(labels) > 1, F.get(labels, F.size(labels) - 1))
    by_country = (F.char_length(suffix) == 2) & (F.size(labels) > 2) & F.get(labels, F.size(labels) - 2).isin(*SECOND_LABELS)
    return rows.withColumn("suffix", suffix).withColumn("domain", F.when(by_country, F.substring_index("host", ".", -3)).otherwise(F.substring_index("host", ".", -2)))


def page_languages(spark: SparkSession, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """(page_id, lang, probability, text_lang, declared, host) of every page; text models from labelled documents.

    A row per page, repeated page_ids included; an empty table gives one; other columns are left out.
    """
    found = LanguageId(spark, TextModel.fit(documents)).run(page_rows(pages))
    return found.withColumnRenamed("id", "page_id")


def document_languages(spark: SparkSession, docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is known with probability ``least`` or more, ``lang`` set to it.

    A document's ``source`` is its host and its ``lang`` what it declares. Texts without letters go.
    Null and repeated doc_ids are told apart by their texts.
    """
    bounded_batches(spark)
    model = TextModel.fit(docs)
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")), F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    own = docs.select(key.alias("k_key"), F.col("text").alias("k_text"), F.col("lang").alias("k_lang"), F.col("source").alias("k_source"), F.struct(*docs.columns).alias("k_row"))
    nothing = F.lit(None).cast("string")
    rows = own.select(F.col("k_key").alias("id"), F.col("k_text").alias("text"), F.lower("k_lang").alias("declared"), F.col("k_source").alias("host"), nothing.alias("suffix"), nothing.alias("domain"))
    found = LanguageId(spark, model).run(rows).filter((F.col("probability") >= least) & (F.col("text_lang") != UNKNOWN) & (F.col("lang") != UNKNOWN))
    decided = found.groupBy(F.col("id").alias("d_key")).agg(F.min("lang").alias("d_lang"))
    met = own.join(decided, F.col("k_key") == F.col("d_key"))
    return met.select(*[F.col("d_lang").alias("lang") if c == "lang" else F.col("k_row")[c].alias(c) for c in docs.columns])
