"""Benchmark decontamination by a prefix-filtered containment join.
Built-in functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.sizing import MAX_BROADCAST_BYTES
from evidentia.session import cut_lineage

# every ASCII character but 0-9, A-Z, a-z, one by one: Java looks such a class up in one table
SEPARATORS = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
WINDOW = 13
MIN_SHARE = 20                 # contaminated: at least one word in MIN_SHARE is hit


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def word_array(text: Column) -> Column:
    """Words of a text (0-9, letters and non-ASCII); null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows: (win, words, len, items), ``items`` the ids that hold it."""
    w = items.select(F.col(id_col).cast("string").alias("item"),
                     word_array(ascii_lower(F.col(text_col))).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    w = w.select("item", "w", F.explode(starts).alias("s")).select(
        "item", F.slice("w", F.col("s"), F.lit(window)).alias("words"))
    w = w.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return w.withColumn("win", F.xxhash64(F.concat_ws(" ", "words"))).withColumn("len", F.size("words"))


def _small(df: DataFrame, row_bytes: int) -> bool:
    return df.count() * row_bytes <= MAX_BROADCAST_BYTES


def benchmark_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key, n_words, n_hit, hit_items
    (sorted strings; null where no word is hit).

    A window can occur only where its rarest word does, so that word is its
    prefix token: the words of the windows are counted over all documents,
    each window is keyed by its rarest one, and only documents' words equal
    to such a key are joined. The position of the key in the window gives the
    place where the window would start; places that begin before the text or
    end after it are out (position and length bounds). Documents with such a
    place are read again and the words are compared one for one.

    Windows with a word that no document has cannot occur and are dropped.
    The window tables are broadcast when measured small; else joined by
    shuffle. Documents are identified by id and hash of the text, so null ids
    and repeated rows are fine; null text has no words; an empty benchmark
    hits nothing. Other columns are ignored.
    """
    wins = cut_lineage(item_windows(items, item_id, item_text, window), "windows")
    win_words = wins.select("win", "len", "words", F.posexplode("words").alias("pos", "word"))
    # matched by full lower case of single words, which never separates what A-Z lower case joins; of a whole
    # text it can, as a letter's lower case may depend on what follows its word (final sigma)
    vocab = win_words.select(F.lower("word").alias("v")).distinct()
    small = _small(win_words, 512)
    hint = F.broadcast if small else (lambda d: d)
    text = F.col(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"),
                       F.split(F.coalesce(text, F.lit("")), SEPARATORS).alias("w"))
    # an empty first or last piece is no word; both are settled before the words are spread, so no row carries its text
    first, last = (F.element_at("w", 1) == "").cast("int"), ((F.element_at("w", -1) == "") & (F.size("w") > 1)).cast("int")
    base = base.select("doc_id", "text_key", first.alias("shift"), (F.size("w") - first - last).alias("n"), "w")
    spots = base.select("doc_id", "text_key", "shift", "n", F.posexplode_outer("w").alias("raw_at", "word")).select(
        "doc_id", "text_key", "n", F.lower("word").alias("word"), (F.col("raw_at") - F.col("shift")).alias("at"))
    counts = spots.join(hint(vocab), F.col("word") == F.col("v"), "left_semi").groupBy("word").agg(
        F.count(F.lit(1)).alias("freq"))
    ranked = win_words.join(counts.withColumnRenamed("word", "c_word"), F.lower("word") == F.col("c_word"), "left")
    keyed = ranked.groupBy("win").agg(
        F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), F.col("pos"), F.lower("word").alias("key"))).alias("rare"),
        F.first("len").alias("len")).filter("rare.freq > 0").select(
        "win", "len", F.col("rare.key").alias("key"), F.col("rare.pos").alias("offset"))
    keyed = cut_lineage(keyed, "window-keys")
    found = spots.join(hint(keyed), F.col("word") == F.col("key")).withColumn("s", F.col("at") - F.col("offset"))
    found = found.filter((F.col("s") >= 0) & (F.col("s") + F.col("len") <= F.col("n")))
    found = found.select("doc_id", "text_key", "s", "win").distinct()
    found = found.join(hint(wins.select(F.col("win").alias("w_win"), "words", "items")), F.col("win") == F.col("w_win"))
    cand = found.groupBy(F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key")).agg(
        F.collect_list(F.struct("s", "words", "items")).alias("cand"))
    cand = cut_lineage(cand, "window-spots")
    key = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    named = key.join(cand, key.doc_id.eqNullSafe(cand.c_id) & (key.text_key == cand.c_key), "left_semi")
    named = named.select("doc_id", "text_key", "text").distinct().join(
        cand, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_key") == F.col("c_key")))
    # a one-element transform names a value, so that Spark works it out once per row and not at each use
    def right(w):
        return F.filter("cand", lambda c: F.slice(w, c["s"] + 1, F.size(c["words"])) == c["words"])

    def result(ok):
        return F.when(F.size(ok) > 0, F.struct(
            F.size(F.array_distinct(F.flatten(F.transform(
                ok, lambda c: F.sequence(c["s"], c["s"] + F.size(c["words"]) - 1))))).cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.transform(ok, lambda c: c["items"])))).alias("hit_items")))
    found_words = F.transform(F.array(word_array(ascii_lower(F.col("text")))), lambda w: right(w))
    checked = named.select(F.col("doc_id").alias("h_id"), F.col("text_key").alias("h_key"),
                           F.element_at(F.transform(found_words, lambda ok: result(ok)), 1).alias("h"))
    checked = checked.filter("h is not null").select("h_id", "h_key", "h.n_hit", "h.hit_items")
    pieces = F.split(F.coalesce(text, F.lit("")), SEPARATORS)
    n = (F.size(pieces) - (F.element_at(pieces, 1) == "").cast("int")
         - ((F.element_at(pieces, -1) == "") & (F.size(pieces) > 1)).cast("int"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), n.cast("long").alias("n_words"))
    out = rows.join(checked, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_key") == F.col("h_key")), "left")
    return out.select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      "hit_items")


def is_contaminated(min_share: int = MIN_SHARE) -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * min_share >= F.col("n_words"))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, with all their columns."""
    bad = benchmark_hits(docs, items, **options).filter(is_contaminated()).select(
        F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    i, t = docs[options.get("id_col", "doc_id")], docs[options.get("text_col", "text")]
    return docs.join(bad, i.eqNullSafe(bad["bad_id"]) & (F.xxhash64(t) == bad["bad_key"]), "left_anti")
