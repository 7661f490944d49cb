"""From raw documents to token ids: five stages, each over all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  ``run`` writes each stage's rows to the shared
folder as Parquet and reads them back for the next, so a lost executor repeats
one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxmill.llm import bpe, langid, mixing, simhash, toxicity
from fluxmill.llm.common import fresh, join_small, stash, table
from fluxmill.llm.queries import vocabulary_path

#: Bits a letter above which a text is in none of the learned languages (their own texts stay below 7, random letters
#: take over 10), and bits that any text may cost besides: a phrase or two, which weigh in short ones.
MOST_BITS = 8.5
SLACK_BITS = 32.0
TOXIC = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and texts that no learned language explains.

    Null and empty texts go; long texts are read whole; without labelled documents
    every text is unexplained and goes; repeated rows are judged alike.
    """
    columns = docs.columns
    name, score, bits, letters = fresh(docs, "lang_pred", "lang_score", "lang_bits", "lang_letters")
    found = langid.identify(docs, langid.references(docs), keep=columns, outputs=(name, score, bits, letters))
    foreign = F.col(bits) * F.col(letters) > MOST_BITS * F.col(letters) + SLACK_BITS
    return found.where((F.col(name) != langid.UND) & ~foreign).select(*columns)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score as toxic (one half or more).

    Null and empty texts stay; long texts are read whole; without labels the
    grammar's own weights judge; repeated rows are judged alike.
    """
    columns = docs.columns
    (score,) = fresh(docs, "toxicity")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=columns, output=score).where(F.col(score) < TOXIC).select(*columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep, of each group of near duplicates, the document with the smallest id.

    Documents are known by their id and a hash of their text, so texts that share an
    id are judged one by one; of texts of one id in one group, and of rows that
    repeat a text, the first stays.  Null and empty texts are near duplicates of each
    other.  Only ids and hashes are grouped; the texts are filtered against those
    that go, without a shuffle while those are few.  Rows with a null id can't be
    named and stay.
    """
    h, key = fresh(docs, "hash", "row")
    marked = docs.withColumn(h, F.xxhash64("text"))
    rows = simhash.near_duplicates(marked, also=[h]).where("doc_id IS NOT NULL")
    groups = rows.groupBy("doc_id", h, "component_id").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(h).over(Window.partitionBy("doc_id", "component_id"))  # texts of one id in one group: seldom more than one
    groups = stash(groups.withColumn("stays", (F.col("doc_id") == F.col("component_id")) & (F.col(h) == first)), "pipeline-groups")
    gone = groups.where(~F.col("stays")).select("doc_id", h)
    out = join_small(marked, gone, ["doc_id", h], "left_anti", gone.count())
    twice = groups.where("stays AND n > 1").select("doc_id", h)
    if (many := twice.count()) == 0:
        return out.select(*docs.columns)
    single = join_small(out, twice, ["doc_id", h], "left_anti", many)
    whole = F.struct(*docs.columns)
    again = join_small(out, twice, ["doc_id", h], "left_semi", many).groupBy("doc_id", h).agg(F.min_by(whole, F.to_json(whole)).alias(key))
    return single.select(*docs.columns).unionByName(again.select(*[F.col(key)[c].alias(c) for c in docs.columns]))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources come near their targets.

    Null and empty texts have no words and are dropped or kept with their source's
    whole passes; a null source is a source; rows that share an id are repeated
    alike, as often as the most of them; rows with a null id stay once.
    """
    n, copies = fresh(docs, "copy", "copies")
    taken = mixing.mix(docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("copies").alias(copies))
    taken = stash(taken, "pipeline-copies")
    out = join_small(docs, taken, ["doc_id"], "left", taken.count())
    times = F.coalesce(F.col(copies), F.lit(1))
    return out.where(times > 0).withColumn(n, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, an empty list for null and empty texts; long texts are encoded whole, repeated rows alike."""
    return bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), vocabulary_path()).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language", language), ("toxicity", civil), ("near_duplicates", distinct), ("mixing", mixed), ("encoding", encoded)]

#: No stage but the mixing could be put in SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
