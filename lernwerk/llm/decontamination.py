"""Benchmark passages in training documents, by a positional inverted index. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: What parts words: ASCII characters but letters and digits, once A-Z are small.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Tables of so many rows at most are broadcast; larger ones are shuffled.
MOST_BROADCAST = 1 << 19
WINDOW = 10


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def bounded(df: DataFrame) -> DataFrame:
    """A written table, as a broadcast where it has ``MOST_BROADCAST`` rows at most."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def item_windows(items: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, phrase, length): each run of ``window`` words of an item, spaced; a shorter item is one window."""
    w = items.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    cuts = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("p"))
    return cuts.select("item", F.array_join("p", " ").alias("phrase"), F.size("p").alias("length")).distinct()


def rarest_terms(phrases: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(phrase, length, t1, o1, t2, gap): the rarest term of each phrase with its place, and the next rarest with how far it follows.

    Rarity is the number of times the documents hold a term. Phrases with a term that they never hold are left out. A
    phrase of one word has an empty second term.
    """
    terms = phrases.select("phrase", "length", F.posexplode(F.split("phrase", " ")).alias("place", "term"))
    sought = cut(terms.select("term").distinct())
    tokens = docs.select(F.explode(words(F.col(text_col))).alias("term"))
    counts = tokens.join(bounded(sought), "term").groupBy("term").agg(F.count("*").alias("n"))
    ranked = terms.join(counts, "term").groupBy("phrase", "length").agg(F.sort_array(F.collect_list(F.struct("n", "term", "place"))).alias("r"))
    first, second = F.col("r")[0], F.get("r", F.lit(1))
    whole = ranked.where(F.size("r") == F.col("length"))
    return whole.select(
        "phrase", "length", first["term"].alias("t1"), first["place"].alias("o1"),
        F.coalesce(second["term"], F.lit("")).alias("t2"), F.coalesce(second["place"] - first["place"], F.lit(0)).alias("gap"),
    )


def candidates(docs: DataFrame, rarest: DataFrame, slop: int = 0, text_col: str = "text") -> DataFrame:
    """(key, start, phrase, length): where the lists of a phrase's two rarest terms meet, moved by their places in it.

    ``rarest`` is a written table. Postings (term, key of the text, position) are stored for its terms alone, once a text whatever
    its copies. The two terms may be ``slop`` words nearer or farther than in the phrase.
    """
    sought = cut(rarest.select(F.explode(F.array("t1", "t2")).alias("term")).where("term <> ''").distinct())
    keyed = docs.select(text_key(F.col(text_col)).alias("key"), words(F.col(text_col)).alias("w"))  # once a text, and not once a word
    tokens = keyed.select("key", F.posexplode("w").alias("at", "term"))
    postings = cut(tokens.join(bounded(sought), "term").select("term", "key", "at").distinct())
    pairs = bounded(cut(rarest.select(F.col("t1").alias("term"), "t2", "gap").distinct()))
    first = postings.join(pairs, "term").select(F.col("term").alias("t1"), "t2", "gap", "key", "at")
    then = F.col("at") + F.col("gap")
    both = first.where("t2 <> ''").withColumn("then", F.explode(F.sequence(then - slop, then + slop)) if slop else then)
    second = postings.select(F.col("term").alias("t2"), "key", F.col("at").alias("then"))
    met = both.join(second, ["t2", "key", "then"], "left_semi").drop("then")
    met = (met.distinct() if slop else met).unionByName(first.where("t2 = ''"))
    found = met.join(bounded(rarest), ["t1", "t2", "gap"])
    return found.select("key", (F.col("at") - F.col("o1")).alias("start"), "phrase", "length")


def matches(docs: DataFrame, phrases: DataFrame, slop: int = 0, text_col: str = "text") -> DataFrame:
    """(key, n_words, hits): texts that hold phrases, once each, with ``hits`` as array of (start, length, phrase, exact).

    ``key`` is ``text_key`` of the text. What the two lists of a phrase leave is checked on the words themselves: each word of
    the phrase stands at its place, or with ``slop`` within so many words of where the rarest one puts it (a proximity
    match; ``exact`` tells which). Positions count a text's words from 0. The words of texts with candidates alone are looked at again; they are
    found by a broadcast of their keys up to ``MOST_BROADCAST`` and by a join beyond.
    """
    rarest = cut(rarest_terms(phrases, docs, text_col))
    lists = cut(candidates(docs, rarest, slop, text_col).groupBy("key").agg(F.collect_list(F.struct("start", "length", "phrase", F.split("phrase", " ").alias("p"))).alias("c")))
    texts = docs.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("t"))
    keys = bounded(lists.select("key"))
    held = texts.join(keys, "key", "left_semi").groupBy("key").agg(F.first("t").alias("t")).select("key", words(F.col("t")).alias("w"))

    def stands(c: Column, reach: int) -> Column:
        # single words are fetched: a slice would copy the whole text for each candidate
        word = lambda at: F.get("w", at)
        there = (lambda at, p: word(at) == p) if not reach else (lambda at, p: F.exists(F.sequence(at - reach, at + reach), lambda x: F.coalesce(word(x) == p, F.lit(False))))
        return F.forall(F.sequence(F.lit(0), c["length"] - 1), lambda i: F.coalesce(there(c["start"] + i, F.get(c["p"], i)), F.lit(False)))

    told = lambda c: F.struct(c["start"].alias("start"), c["length"].alias("length"), c["phrase"].alias("phrase"), stands(c, 0).alias("exact"))
    checked = held.join(lists, "key").select("key", F.size("w").alias("n_words"), F.transform(F.filter("c", lambda c: stands(c, slop)), told).alias("hits"))
    return checked.where(F.size("hits") > 0)


def covered(spans: Column) -> Column:
    """How many places an array of (start, length, ...) covers."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))

    def add(s: Column, x: Column) -> Column:
        end = x["start"] + x["length"]
        return F.struct((s["n"] + F.greatest(end - F.greatest(x["start"], s["upto"]), F.lit(0))).alias("n"), F.greatest(end, s["upto"]).alias("upto"))

    return F.aggregate(F.sort_array(spans), zero, add)["n"]


RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """How far each document holds benchmark passages.

    Adds ``n_words``, ``n_hit`` (words inside any occurrence of a window of ``window`` item words), ``n_items`` (items with such
    windows), ``items_sha256`` (of their ids, sorted as strings, comma-joined) and ``contaminated``; columns of these
    names are replaced. Words are runs of ASCII letters and digits and of other characters, small A-Z.

    A null or empty text has no words and no hits. An item of fewer words than a window is one window; one without words has
    none. Items that repeat an id are one item; items with a null id mark words but are not counted. Repeated rows and copies
    are indexed once, and each row has its own result. Without documents or without items there are no hits. Very long texts
    are exploded into rows; only the words of a text with candidates are held as one array. The postings of a hot word or
    passage are spread by text and place; rows of a hot text meet its one result in a join that adaptive execution splits.
    """
    d = docs.drop(*RESULTS)
    windows = cut(item_windows(items, window, item_col, item_text))
    found = cut(matches(d, windows.select("phrase", "length").distinct(), 0, text_col))
    whose = found.select("key", F.explode(F.array_distinct(F.transform("hits", lambda h: h["phrase"]))).alias("phrase")).join(windows, "phrase")
    named = whose.groupBy("key").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    result = found.join(named, "key").select("key", covered(F.col("hits")).alias("n_hit"), "items")
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
    rows = d.select("*", text_key(F.col(text_col)).alias("__key"), counted.alias("n_words"))
    joined = rows.join(result.withColumnRenamed("key", "__key"), "__key", "left")
    none = F.array().cast("array<string>")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        *d.columns, "n_words", n_hit.alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
