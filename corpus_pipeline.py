"""A pipeline over ``documents``: each stage decides on what the one before kept."""

from pyspark.sql import functions as F

from plyclock.llm import langid, neardup, packing, privacy, rules
from plyclock.llm.common import crc_mod3, documents, free_name, stored

#: Documents whose language is less sure than this are rejected.
SURE = 0.5


def language(spark, docs, sf_dir):
    """Rejects documents without a language (no text, no letter) or with an unsure one."""
    model = langid.fit_languages(documents(spark, sf_dir).filter(crc_mod3() != 1))
    label, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    named = langid.identify(docs, model, label=label, score=score)
    return named.filter((F.col(label) != langid.UNDETERMINED) & (F.col(score) >= SURE)).select(*docs.columns)


def quality(spark, docs, sf_dir):
    """Rejects documents whose predicted quality is 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(crc_mod3() != 1)
    model = rules.fit_rules(documents(spark, sf_dir), labels)
    score, predicted = free_name(docs, "score"), free_name(docs, "predicted")
    return rules.score_documents(docs, model, score=score, predicted=predicted).filter(
        F.col(predicted) == 1).select(*docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """Keeps the document with the smallest doc_id of each group of near duplicates.

    Of rows that share a doc_id and a set of shingles one stays; different texts of one
    doc_id are judged each by its own.  Of rows without a doc_id, or of blank ones, only
    those equal in doc_id and text are repeats.
    """
    decided = neardup.judged(docs).filter("kept")
    by_text = F.when(F.col("doc_id").isNull() | F.col("digest").isNull(), F.col("text_hash"))
    kept = stored(decided.groupBy("doc_id", "digest", by_text.alias("_by_text")).agg(
        F.min("text_hash").alias("text_hash"), F.count("*").alias("n")))
    label = free_name(docs, "_text_hash")
    of = kept.select(F.col("doc_id").alias("_of"), F.col("text_hash").alias("_hash"))
    hashed = docs.withColumn(label, F.xxhash64("text"))
    chosen = hashed.join(of, hashed["doc_id"].cast("long").eqNullSafe(of["_of"])
                         & (hashed[label] == of["_hash"]), "left_semi")
    if kept.filter("n > 1").limit(1).count():
        chosen = chosen.dropDuplicates(["doc_id", label])
    return chosen.drop(label)


def personal_data(spark, docs, sf_dir):
    """Masks personal data and the terms that reveal it; rejects nothing."""
    private, clean = privacy.sanitise(docs)
    return private.unionByName(clean).select(*docs.columns)


def best_fit(spark, docs, sf_dir):
    """Packs what is left into sequences; one row per piece."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("best_fit", best_fit),
]

#: Learned models, connected groups and tokenizers are beyond SQL; the tests hold most of
#: the operators behind the stages, not every stage, against brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to ``documents``, each result written and read again."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
