"""Language identification by Bayesian evidence fusion.

A row's log odds over the languages are a sum of
- its text's likelihood under byte-trigram models learned from labelled texts, tempered so that no text counts for more
  than EFFECTIVE trigrams;
- how likely its declared markup language and its address suffix are under each language, from tables that grouped aggregation
  of the other rows' text posteriors makes;
- its host's prior: the posteriors of the host's other rows, smoothed by those of its domain, and these by the corpus's.
Rows whose best posterior is below ACCEPT, whose text fits no language, or that have neither text nor other evidence, are
not accepted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bytes_of, column, has, store

#: Languages are those whose labelled texts have so many trigrams, at most MAX_LANGUAGES of them: those of most texts.
LEAST_EVIDENCE, MAX_LANGUAGES = 500, 64
BINS = 1 << 14
EFFECTIVE = 60
#: Rows' worth of the level above in a smoothed prior, and of evenness in an evidence table.
SMOOTH, EVEN = 5.0, 2.0
ACCEPT, LEAST_TRIGRAMS = 0.7, 12
#: Cells of a model merged at once.
BLOCK = 1 << 11

#: Elements whose text is none of the page's.
_OPEN = re.compile(rb"(?i)<(?:(script|style|nav|footer|header|head)\b|!--)")
_CLOSE = {name: re.compile(rb"(?i)</" + name + rb"\s*>") for name in (b"script", b"style", b"nav", b"footer", b"header", b"head")} | {b"": re.compile(b"-->")}
_TAG = re.compile(rb"<[^>]*>")
#: Bytes that are no letters become spaces; bytes above 127 stay.
_LETTERS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def _without_noise(html: bytes) -> bytes:
    """html without comments and the elements of _CLOSE; what is never closed stays. Each close is sought once from where the last was, so the time is linear."""
    out, at, begin, open_for_good = [], 0, 0, set()
    while m := _OPEN.search(html, at):
        name = (m[1] or b"").lower()
        end = None if name in open_for_good else _CLOSE[name].search(html, m.end())
        if end:
            out += [html[begin : m.start()], b" "]
            at = begin = end.end()
        else:
            open_for_good.add(name)
            at = m.end()
    return b"".join([*out, html[begin:]])


def visible_text(html: bytes) -> bytes:
    """The text of a page without its scripts, styles, navigation and tags."""
    plain = _without_noise(html)
    end = plain.rfind(b">") + 1  # up to there every tag has an end
    plain = _TAG.sub(b" ", plain[:end]) + plain[end:]
    return unescape(plain.decode("utf-8", "replace")).encode() if b"&" in plain else plain


def trigrams(text: bytes) -> np.ndarray:
    """The bins of a text's byte trigrams; runs of other bytes than letters count as one space."""
    words = text.lower().translate(_LETTERS).split()
    if not words:
        return np.zeros(0, np.int64)
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return (code >> np.uint32(32 - (BINS.bit_length() - 1))).astype(np.int64)


class TextModel:
    def __init__(self, languages: list[str], counts: np.ndarray, share: np.ndarray):
        """counts: a row of trigram counts for each language; share: of the labelled texts."""
        self.languages, self.share = languages, share
        p = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BINS)
        self.log = np.log(p).T.astype(np.float32)

    def likelihood(self, text: bytes) -> tuple[np.ndarray, int]:
        """Tempered log likelihood under each language, and the number of trigrams."""
        t = trigrams(text)
        if not len(t):
            return np.zeros(len(self.languages)), 0
        return self.log[t].sum(0, dtype=np.float64) * min(1.0, EFFECTIVE / len(t)), len(t)


def fit(texts: DataFrame, text_col: str = "text", lang_col: str = "lang") -> TextModel:
    """Counts over all labelled texts. Null languages and texts are left out; without any, the only language is `und`."""
    rows = texts.select(F.col(lang_col).cast("string").alias("lang"), bytes_of(F.col(text_col)).alias("text")).where("lang IS NOT NULL")
    top = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    total = sum(r["count"] for r in top)
    share = {r.lang: r["count"] / total for r in sorted(top, key=lambda r: r.lang)}
    place = {lang: i for i, lang in enumerate(share)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(place), BINS), np.int64)
        for b in batches:
            for lang, t in zip(column(b, "lang"), column(b, "text"), strict=True):
                if lang in place:
                    sums[place[lang]] += np.bincount(trigrams(t), minlength=BINS)
        for i in range(len(place)):
            for k in range(0, BINS, BLOCK):
                if sums[i, k : k + BLOCK].any():
                    yield pa.RecordBatch.from_pydict({"block": pa.array([i * BINS // BLOCK + k // BLOCK], pa.int64()), "sums": [sums[i, k : k + BLOCK].tobytes()]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for block, sums in zip(column(b, "block"), column(b, "sums"), strict=True):
                held[block] = held.get(block, 0) + np.frombuffer(sums, np.int64)
        for block, sums in held.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "sums": [sums.tobytes()]})

    parts = arrow_map(rows, count, "block bigint, sums binary")
    parts = parts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block").mapInArrow(merge, "block bigint, sums binary")
    counts = np.zeros(len(place) * BINS, np.int64)
    for r in parts.collect():  # BINS numbers for each language
        counts[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.sums, np.int64)
    counts = counts.reshape(-1, BINS)
    kept = np.flatnonzero(counts.sum(1) >= LEAST_EVIDENCE)
    if not len(kept):
        return TextModel(["und"], np.zeros((1, BINS)), np.ones(1))
    return TextModel([list(place)[i] for i in kept], counts[kept], np.array(list(share.values()))[kept])


def address_parts(url: Column) -> dict[str, Column]:
    """host, domain (its last two labels) and suffix (the last) of an address; null where it has no host."""
    host = F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    return {"host": host, "domain": F.substring_index(host, ".", -2), "suffix": F.substring_index(host, ".", -1)}


def declared_language(html: Column) -> Column:
    """Primary part of the html tag's lang attribute, lower-cased; null without one."""
    lang = F.lower(F.regexp_extract(F.coalesce(html.cast("string"), F.lit("")), r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})\b", 1))
    return F.when(lang != "", lang)


def _softmax(log: Column) -> Column:
    top = F.array_max(log)
    raised = F.transform(log, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, b: a + b)
    return F.transform(raised, lambda x: x / total)


def identify(df: DataFrame, model: TextModel, id_col: str, text_col: str, declared: Column | None = None, url: Column | None = None, host: Column | None = None, markup: bool = False) -> DataFrame:
    """(row, id, lang, posterior, text_lang, declared, host, n_trigrams, accepted) for each row of df; row numbers df's rows as they are read.

    declared, url and host are columns of df; host, if given, stands for the address's. Null and empty texts have no text evidence, null
    declarations and hosts none of theirs; a row with none at all gets the corpus's prior and isn't accepted. Ties go to the first language in
    alphabetical order. Repeated rows and null ids are kept. Extra columns are not read.
    """
    none = F.lit(None).cast("string")
    parts = address_parts(url) if url is not None else {"host": none, "domain": none, "suffix": none}
    if host is not None:
        parts |= {"host": host.cast("string")}
    source = df.select(F.col(id_col).alias("id"), bytes_of(F.col(text_col)).alias("text"), (declared if declared is not None else none).alias("declared"), *(c.alias(k) for k, c in parts.items()))
    shared = df.sparkSession.sparkContext.broadcast(model)
    langs = model.languages
    kept = ["id", "declared", "host", "domain", "suffix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.likelihood(visible_text(t) if markup else t) for t in column(b, "text")]
            cols = [b.column(b.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([x.tolist() for x, _ in found], pa.list_(pa.float64())), pa.array([n for _, n in found], pa.int64())], [*kept, "log", "n_trigrams"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = arrow_map(source, run, f"id {kind}, declared string, host string, domain string, suffix string, log array<double>, n_trigrams bigint")
    base = np.maximum(model.share, 1e-9)
    prior = F.array(*[F.lit(float(x)) for x in np.log(base / base.sum())])
    rows = rows.withColumn("log", F.coalesce("log", F.array(*[F.lit(0.0)] * len(langs)))).withColumn("text_post", _softmax(F.zip_with("log", prior, lambda a, b: a + b)))
    rows = rows.withColumn("text_fit", F.array_max("log") / F.greatest(F.lit(1), F.least(F.col("n_trigrams"), F.lit(EFFECTIVE))))
    # A declaration counts as its language's, or as another one.
    rows = rows.withColumn("declared", F.when(F.col("declared").isNull() | F.col("declared").isin(langs), F.col("declared")).otherwise("other"))
    rows = store(rows.withColumn("row", F.monotonically_increasing_id()), "language-rows")
    judged = rows.where(F.col("n_trigrams") >= LEAST_TRIGRAMS)
    each = range(len(langs))
    sums = [F.sum(F.col("text_post")[i]).alias(f"s{i}") for i in each]
    array = lambda prefix="s": F.array(*[F.col(f"{prefix}{i}") for i in each])
    whole = judged.agg(*sums).first()
    overall = [float(whole[f"s{i}"] or 0.0) for i in each]

    # A row's own posterior is no part of what is held against it.
    zero = F.array(*[F.lit(0.0)] * len(langs))
    own = F.when(F.col("n_trigrams") >= LEAST_TRIGRAMS, F.col("text_post")).otherwise(zero)
    others = lambda c: F.coalesce(F.zip_with(F.col(c), own, lambda a, b: F.greatest(a - b, F.lit(0.0))), zero)
    every = F.zip_with(F.array(*map(F.lit, overall)), own, lambda a, b: F.greatest(a - b, F.lit(0.0)))

    def with_evidence(rows: DataFrame, key: str) -> DataFrame:
        """rows with the log of the share that their value of key has among the other rows of each language; of no value, zeros."""
        sums_of = store(judged.where(F.col(key).isNotNull()).groupBy(key).agg(*sums), f"language-{key}").select(key, array().alias(f"{key}_sum"))
        even = EVEN / (len(langs) + 2)
        log = F.zip_with(others(f"{key}_sum"), every, lambda s, n: F.log((s + even) / (n + EVEN)))
        return rows.join(sums_of, key, "left").withColumn(f"{key}_log", F.when(F.col(key).isNotNull(), log).otherwise(zero)).drop(f"{key}_sum")

    for key in ("declared", "suffix"):
        rows = with_evidence(rows, key)
    domains = store(judged.where("domain IS NOT NULL").groupBy("domain").agg(*sums), "language-domains").select("domain", array().alias("domain_sum"))
    hosts = store(judged.where("host IS NOT NULL").groupBy("host").agg(*sums), "language-hosts").select("host", array().alias("host_sum"))
    rows = rows.join(domains, "domain", "left").join(hosts, "host", "left")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    smoothed = lambda c, above: F.zip_with(F.col(c), above, lambda x, p: (x + SMOOTH * p) / (F.col(f"{c}_n") + SMOOTH))
    rows = rows.withColumns({"domain_sum": others("domain_sum"), "host_sum": others("host_sum")})
    rows = rows.withColumns({"domain_sum_n": total(F.col("domain_sum")), "host_sum_n": total(F.col("host_sum"))})
    share = F.array(*[F.lit((x + float(p)) / (sum(overall) + 1)) for x, p in zip(overall, base / base.sum(), strict=True)])
    rows = rows.withColumn("domain_prior", smoothed("domain_sum", share))
    rows = rows.withColumn("host_prior", smoothed("host_sum", F.col("domain_prior")))
    rows = rows.withColumn("log", F.zip_with("log", F.transform("host_prior", lambda x: F.log(F.greatest(x, F.lit(1e-12)))), lambda a, b: a + b))
    for key in ("declared", "suffix"):
        rows = rows.withColumn("log", F.zip_with("log", f"{key}_log", lambda a, b: a + b))
    rows = rows.withColumn("post", _softmax(F.col("log")))
    best = F.array_max("post")
    name = lambda post: F.element_at(F.array(*map(F.lit, langs)), F.array_position(post, F.array_max(post)).cast("int"))
    known = (F.col("n_trigrams") >= LEAST_TRIGRAMS) | F.col("declared").isNotNull() | (F.col("host_sum_n") > 0)
    # A text that every model finds less likely than evenly spread trigrams is in none of the languages.
    foreign = (F.col("n_trigrams") >= LEAST_TRIGRAMS) & (F.col("text_fit") < -float(np.log(BINS)))
    accepted = (best >= ACCEPT) & known & ~foreign & F.lit(langs != ["und"])
    return rows.select("row", "id", name(F.col("post")).alias("lang"), best.alias("posterior"), F.when(F.col("n_trigrams") > 0, name(F.col("text_post"))).alias("text_lang"), "declared", "host", "n_trigrams", accepted.alias("accepted"))


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """identify() for pages(page_id, url, html)."""
    url = F.col("url") if has(pages, "url") else None
    return identify(pages, model, "page_id", "html", declared_language(F.col("html")), url, markup=True)
