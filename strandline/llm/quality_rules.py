"""Quality rules: surface counts, and the divergence of a text's histograms from language references.

Everything is built of SQL functions: no row leaves its partition until its counts are made. A text's characters are
dealt into CLASSES and its words into the common words of each language (and the rest). Languages are those that the texts
declare, and a language's common words are the COMMON words that its texts
hold most often, by grouped counts over all texts. The MAX_LANGUAGES languages of most texts are part of the plan; any others stay in tables,
and texts meet their references in a join, by the same formulas. The references are the same histograms added up over all texts of a language that
pass the base rules, of which there must be LEAST_TEXTS. A text is kept if it passes the base rules and its Jensen-Shannon
distance to the nearest language is within MAX_DISTANCE and what its length allows; texts of fewer than MIN_WORDS words are
too short for a histogram, and texts that declare a language without a reference have none to be held against: both are judged by the base rules alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, discard, has, store

#: Base rules: least words, and the largest share in hundredths of words within repeated windows.
LEAST_WORDS, MOST_REPEATED, SPAN = 10, 20, 5
#: Texts with fewer words get no verdict by histogram.
MIN_WORDS = 50
#: Largest mean of the two Jensen-Shannon distances (characters, common words), from 0 to 1. Histograms of n words lie
#: about 1 / sqrt(n) off by chance, so short texts may be as far as FLOOR + NOISE / sqrt(n).
MAX_DISTANCE, FLOOR, NOISE = 0.15, 0.09, 1.25
#: Common words of a language; languages that are part of the plan (a driver's row for each word), others being joined; and texts of a language that make a reference.
COMMON, MAX_LANGUAGES, LEAST_TEXTS = 18, 64, 20
#: Classes of characters, as patterns; what no pattern takes is the last class, white space the one before.
CLASSES = ("[A-Z]+", "[a-z]+", "[0-9]+", "[.,;:!?'\"()-]+")
SYMBOLS = "[#*$%&|<>]"
#: Rejected rows (8 bytes each) that are broadcast at most; more are joined.
BROADCAST_ROWS = 2_000_000
#: Rows of further languages' words (some 100 bytes each) that are broadcast at most; more are joined.
BROADCAST_WORDS = 100_000


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP, -1), "")


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of SPAN words whose words occur twice or more."""

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(pairs, _starts)
        zero = F.struct(F.lit(0).alias("n"), F.lit(-SPAN).alias("last"))
        return F.aggregate(F.array_sort(starts), zero, lambda acc, i: F.struct((acc.n + F.least(F.lit(SPAN), i - acc.last)).alias("n"), i.alias("last")), lambda acc: acc.n)

    def _starts(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        same = lambda i, j: pairs[i].h == pairs[j].h
        twice = F.transform(pairs, lambda p, i: F.when(((i > 0) & same(i, F.greatest(i - 1, F.lit(0)))) | ((i < last) & same(i, F.least(i + 1, last))), p.i))
        return F.filter(twice, lambda i: i.isNotNull())

    def count(words: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(words) - SPAN)
        hashes = F.transform(at, lambda i: F.xxhash64(*[words[i + k] for k in range(SPAN)]))
        return F.when(F.size(words) < SPAN, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))

    return let(words, count)


def _lang(df: DataFrame, lang_col: str) -> Column:
    return F.col(lang_col).cast("string") if has(df, lang_col) else F.lit(None).cast("string")


def _declared(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return df.select(_lang(df, lang_col).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("lang IS NOT NULL")


def _commonest(rows: DataFrame) -> DataFrame:
    """(lang, word, nth) of the COMMON words that each language of rows(lang, text) holds most often."""
    counts = rows.select("lang", F.explode(words_of(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    return counts.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("nth") <= COMMON).drop("n")


def languages(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """The MAX_LANGUAGES languages that most texts declare, each with its common words: most frequent first, ties in order."""
    rows = _declared(df, text_col, lang_col)
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    found = {r.lang: [] for r in most.collect()}
    for r in sorted(_commonest(rows.where(F.col("lang").isin(list(found)))).collect(), key=lambda r: r.nth):
        found[r.lang].append(r.word)
    return found


def further_words(df: DataFrame, words: dict[str, list[str]], text_col: str = "text", lang_col: str = "lang") -> DataFrame | None:
    """(lang, word, nth) of all languages beyond words that have the texts for a reference; None where there are none."""
    if len(words) < MAX_LANGUAGES:
        return None
    rows = _declared(df, text_col, lang_col).where(~F.col("lang").isin(list(words)))
    langs = rows.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_TEXTS)
    top = store(_commonest(rows.join(langs, "lang", "left_semi")), "quality-words")
    if not top.isEmpty():
        return top
    discard(top)
    return None


def _vocabulary(words: dict[str, list[str]]) -> list[str]:
    return sorted({w for own in words.values() for w in own})


def with_counts(df: DataFrame, words: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", with_text: bool = False) -> DataFrame:
    """Per row of df: id, lang, its place `at`, the base counts, base_failed, and arrays `chars` and `common` of counts; words: languages(). with_text: the text too."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    length = F.length("text")
    without = lambda pattern: F.length(F.regexp_replace("text", pattern, ""))
    lines = F.filter(F.split("text", "\n", -1), lambda s: F.length(F.regexp_replace(s, GAP, "")) > 0)
    vocabulary, own_text = _vocabulary(words), ["text"] * with_text

    def facts(words: Column) -> Column:
        found = F.filter(words, lambda w: w.isin(vocabulary))
        every = F.array(*map(F.lit, vocabulary)).cast("array<string>")
        common = let(found, lambda f: F.transform(every, lambda c: F.size(F.filter(f, lambda w: w == c))))
        return F.struct(F.size(words).cast("bigint").alias("n_words"), repeated_words(words).cast("bigint").alias("n_repeat_words"), common.alias("common"))

    rows = df.select(F.col(id_col).alias("id"), _lang(df, lang_col).alias("lang"), text.alias("text")).select(
        "id",
        "lang",
        length.alias("length"),
        without(GAP).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        let(words_of(F.col("text")), facts).alias("facts"),
        F.monotonically_increasing_id().alias("at"),
        F.array(*[length - without(p) for p in CLASSES]).alias("chars"),
        *own_text,
    )
    rows = rows.select("id", "lang", "length", "word_chars", "n_symbols", "n_dup_lines", "chars", "at", "facts.n_words", "facts.n_repeat_words", "facts.common", *own_text)
    space = F.col("length") - F.col("word_chars")
    rest = F.col("word_chars") - F.aggregate("chars", F.lit(0), lambda a, b: a + b)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumns({"chars": F.concat("chars", F.array(space, rest)).cast("array<double>"), "common": F.col("common").cast("array<double>"), "base_failed": failed}).drop("length")


def _share(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1.0)))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)


def _js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), _total(terms)))


def _shares_of(vocabulary: list[str], own: list[str]) -> Callable[[Column, Column], Column]:
    """Shares of a language's common words among all words, and of the rest."""
    places = [vocabulary.index(w) for w in own]

    def shares(common: Column, n_words: Column) -> Column:
        counts = F.array(*[common[i] for i in places]).cast("array<double>")
        return _share(F.concat(counts, F.array(n_words - _total(counts))), n_words)

    return shares


def references(rows: DataFrame, words: dict[str, list[str]]) -> dict[str, dict[str, float]]:
    """The counts of each language, added up over the rows of with_counts() that pass the base rules: a row for each language."""
    good = rows.where(~F.col("base_failed") & F.col("lang").isin(list(words)))
    sums = [F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(len(CLASSES) + 2)] + [F.sum(F.col("common")[i]).alias(f"w{i}") for i in range(len(_vocabulary(words)))]
    found = good.groupBy("lang").agg(F.count("*").alias("texts"), F.sum("n_words").alias("n"), *sums).where(F.col("texts") >= LEAST_TEXTS)
    return {r.lang: r.asDict() for r in found.collect()}


def further_nearest(rows: DataFrame, top: DataFrame, refs: dict[str, dict[str, float]]) -> DataFrame:
    """(at, further) for rows of with_counts(with_text=True) that are held against references: distance and lang of the nearest one of top's languages, top being further_words()."""
    few = lambda df: F.broadcast(df) if n <= BROADCAST_WORDS else df
    n = top.count()
    spoken = rows.select("at", F.explode(words_of(F.col("text"))).alias("word")).groupBy("at", "word").agg(F.count("*").cast("double").alias("c"))
    tally = store(spoken.join(few(top.select("word").distinct()), "word", "left_semi"), "quality-tally")
    good = rows.where(~F.col("base_failed")).join(few(top.select("lang").distinct()), "lang", "left_semi")
    sums = good.groupBy("lang").agg(F.count("*").alias("texts"), F.sum("n_words").cast("double").alias("n"), F.array(*[F.sum(F.col("chars")[i]) for i in range(len(CLASSES) + 2)]).alias("chars"))
    said = good.select("at", "lang").join(tally, "at").join(few(top), ["lang", "word"]).groupBy("lang", "word").agg(F.sum("c").alias("c"))
    own = top.join(said, ["lang", "word"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("nth", "word", F.coalesce("c", F.lit(0.0)).alias("c")))).alias("own"))
    found = own.join(sums.where(F.col("texts") >= LEAST_TEXTS), "lang").select("lang", F.col("own.word").alias("words"), _share(F.col("own.c"), F.col("n")).alias("shares"), _share(F.col("chars"), _total(F.col("chars"))).alias("char_ref"))
    found = store(found.withColumn("word_ref", F.concat("shares", F.array(F.greatest(F.lit(0.0), 1 - _total(F.col("shares")))))).drop("shares"), "quality-further")
    main = F.col("lang").isNull() | F.col("lang").isin(list(refs))
    held = rows.where(main).unionByName(rows.where(~main).join(few(found.select("lang")), "lang", "left_semi").select(*rows.columns))
    counts = tally.groupBy("at").agg(F.map_from_entries(F.collect_list(F.struct("word", "c"))).alias("counts"))
    held = held.select("at", F.col("n_words").cast("double").alias("n_words"), _share(F.col("chars"), _total(F.col("chars"))).alias("chars")).join(counts, "at", "left")
    pairs = held.crossJoin(few(found))
    common = F.transform("words", lambda w: F.coalesce(F.try_element_at("counts", w), F.lit(0.0)))
    shares = let(common, lambda c: _share(F.concat(c, F.array(F.col("n_words") - _total(c))), F.col("n_words")))
    far = (_js_distance(F.col("chars"), F.col("char_ref")) + _js_distance(shares, F.col("word_ref"))) / 2
    nearest = store(pairs.select("at", F.struct(far.alias("distance"), "lang").alias("one")).groupBy("at").agg(F.min("one").alias("further")), "quality-nearest")
    discard(tally, found)
    return nearest


def with_verdicts(rows: DataFrame, refs: dict[str, dict[str, float]], words: dict[str, list[str]], top: DataFrame | None = None) -> DataFrame:
    """rows of with_counts() with distance, lang_found and kept; top: further_words(), for which rows must have their texts."""
    vocabulary, size = _vocabulary(words), len(CLASSES) + 2
    chars = let(F.col("chars"), lambda c: _share(c, _total(c)))
    by_lang = []
    for lang, r in sorted(refs.items()):
        shares, total = _shares_of(vocabulary, words[lang]), sum(r[f"c{i}"] for i in range(size))
        char_ref = F.array(*[F.lit(r[f"c{i}"] / max(total, 1.0)) for i in range(size)])
        word_ref = [r[f"w{vocabulary.index(w)}"] / max(r["n"], 1) for w in words[lang]]
        word_ref = F.array(*map(F.lit, [*word_ref, max(0.0, 1 - sum(word_ref))]))
        far = (_js_distance(chars, char_ref) + _js_distance(shares(F.col("common"), F.col("n_words").cast("double")), word_ref)) / 2
        by_lang.append(F.struct(far.alias("distance"), F.lit(lang).alias("lang")))
    nearest = reduce(F.least, [by_lang[0], by_lang[0], *by_lang[1:]]) if by_lang else F.lit(None).cast("struct<distance:double,lang:string>")
    if top is None:
        nearest = F.when(F.col("lang").isNull() | F.col("lang").isin(list(refs)), nearest)
    else:
        further = further_nearest(rows, top, refs)
        rows = rows.join(further, "at", "left")
        held = F.col("lang").isNull() | F.col("lang").isin(list(refs)) | F.col("further").isNotNull()
        nearest = F.when(held, F.least(nearest, F.col("further")))
    rows = rows.withColumn("nearest", nearest).withColumns({"distance": F.col("nearest.distance"), "lang_found": F.col("nearest.lang")}).drop("nearest")
    allowed = F.greatest(F.lit(MAX_DISTANCE), FLOOR + NOISE / F.sqrt(F.greatest(F.col("n_words"), F.lit(1))))
    odd = (F.col("n_words") >= MIN_WORDS) & (F.coalesce("distance", F.lit(0.0)) > allowed)
    return rows.withColumn("kept", ~F.col("base_failed") & ~odd)


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, lang_found, kept for each row of df.

    Null texts count as empty and fail the base rules. Repeated rows get a row each. Rows without a language count for
    no reference and are held against all. Without any reference (an empty table) and where the declared language has none the base rules
    decide; distance is then null. Windows of words are told apart by 64-bit hashes. A missing language column is as one of
    nulls; other columns are not read.
    """
    words = languages(df, text_col, lang_col)
    top = further_words(df, words, text_col, lang_col)
    rows = store(with_counts(df, words, id_col, text_col, lang_col, top is not None), "quality-counts")
    out = with_verdicts(rows, references(rows, words), words, top)
    return out.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "lang_found", "kept")


def kept_rows(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """df's rows that judge() keeps, whole. df must give the same rows in the same order when it is read again, as stored tables do: rejected rows are told by their place."""
    words = languages(df, text_col, lang_col)
    top = further_words(df, words, text_col, lang_col)
    rows = store(with_counts(df, words, text_col, text_col, lang_col, top is not None).drop("id"), "quality-counts")
    gone = store(with_verdicts(rows, references(rows, words), words, top).where("NOT kept").select("at"), "quality-gone")
    discard(rows)
    placed = df.select(F.struct(*[df[c] for c in df.columns]).alias("source_row"), F.monotonically_increasing_id().alias("at"))
    return placed.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "at", "left_anti").select("source_row.*")
