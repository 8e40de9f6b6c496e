"""A claim writer that ranks sentences by a model of the corpus (M2).

Words weigh by their rarity among all papers, sentences score by BM25 with
sentence lengths, and a question gets claims only from sentences that cover
enough of its weight: a question about another subject shares its frequent
words with the corpus and lacks the rare ones, so it gets none. A sentence that
adds few new words to the better ones is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import sentences, tokens

# --- fixed values of the ranked claim writer ---------------------------------------
K1 = 1.2                       # saturation of BM25
B = 0.75                       # weight of the sentence's length
MIN_COVER = 0.3                # share of the question's weight that a sentence must hold
MIN_NOVEL = 40                 # percent of a sentence's words that no better sentence has
# -----------------------------------------------------------------------------------
DECIMALS = 9                   # scores are compared at so many decimals: sums come in any order


def corpus_model(papers: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, int, float]:
    """(weights, papers, mean words of a sentence) of the papers (paper_id,
    abstract). ``weights`` has (token, idf) for every token of ``vocabulary``
    (column token), those of no paper included. Papers without text count for
    nothing. Counts are combined in each task before the shuffle."""
    p = papers.select("abstract").filter(F.col("abstract").isNotNull())
    lengths = p.select(F.explode(F.transform(sentences("abstract"), lambda s: F.size(F.array_distinct(tokens(s))))).alias("n"))
    size = p.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    mean = lengths.filter("n > 0").agg(F.avg("n").alias("m")).first()["m"] or 1.0
    words = vocabulary.select("token").distinct()
    held = p.select(F.explode(F.array_distinct(tokens("abstract"))).alias("h_token"))
    df = held.groupBy("h_token").agg(F.count(F.lit(1)).alias("df"))
    w = words.join(df, F.col("token") == F.col("h_token"), "left")
    n = F.coalesce("df", F.lit(0))
    return w.select("token", F.log(1.0 + (F.lit(float(size)) - n + 0.5) / (n + 0.5)).alias("idf")), size, float(mean)


def ranked_claims(questions: DataFrame, retrieved: DataFrame, papers: DataFrame, *, min_cover: float = MIN_COVER,
                  min_novel: int = MIN_NOVEL, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, claim_pos, claim_id, text, paper_ids, score): claims from the
    sentences of ``retrieved`` (qid, rank, paper_id, abstract) that hold at
    least ``min_cover`` of the weight of the words of the question, best BM25
    score first (ties: rank of the paper, place in it). A sentence after the
    first stays if ``min_novel`` percent of its words stand in no better one.
    Words count once per sentence. There is no bound on the claims; questions
    without words, null texts and texts without sentences give none."""
    q = questions.select("qid", F.explode(F.array_distinct(tokens("question"))).alias("token"))
    weights, _, mean = corpus_model(papers, q)
    qt = q.join(weights, "token").select(F.col("qid").alias("w_qid"), F.col("token").alias("w_token"), "idf")
    whole = qt.groupBy("w_qid").agg(F.sum("idf").alias("whole")).withColumnRenamed("w_qid", "a_qid")
    s = retrieved.select("qid", "rank", "paper_id", F.posexplode(sentences("abstract")).alias("p", "s"))
    words = s.select("qid", "rank", "p", F.explode(F.array_distinct(tokens("s"))).alias("token"))
    got = words.join(qt, (F.col("qid") == F.col("w_qid")) & (F.col("token") == F.col("w_token")), "left").groupBy(
        "qid", "rank", "p").agg(F.sum("idf").alias("held"), F.count(F.lit(1)).alias("n"))
    score = F.round(F.col("held") * (k1 + 1) / (1 + k1 * (1 - b + b * F.col("n") / F.lit(mean))), DECIMALS)
    near = got.join(whole, F.col("qid") == F.col("a_qid")).filter(
        F.round(F.col("held") / F.col("whole"), DECIMALS) >= min_cover)
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), "rank", "p")
    near = near.withColumn("score", score).withColumn("turn", F.row_number().over(best)).select(
        "qid", "rank", "p", "n", "score", "turn")
    # a word is new in the best sentence of its question that has it
    mine = words.join(near.select("qid", "rank", "p", "turn"), ["qid", "rank", "p"])
    novel = mine.groupBy("qid", "token").agg(F.min("turn").alias("turn")).groupBy("qid", "turn").agg(
        F.count(F.lit(1)).alias("novel"))
    kept = near.join(novel, ["qid", "turn"]).filter((F.col("turn") == 1) | (F.col("novel") * 100 >= F.col("n") * min_novel))
    pos = F.row_number().over(Window.partitionBy("qid").orderBy("turn")).cast("int")
    return kept.withColumn("claim_pos", pos).join(s, ["qid", "rank", "p"]).select(
        "qid", "claim_pos", F.col("claim_pos").alias("claim_id"), F.trim("s").alias("text"),
        F.array("paper_id").alias("paper_ids"), "score")
