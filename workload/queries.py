"""Every operator of the engine as a query over the driver tables.

Each takes (spark, sf_dir) and returns a DataFrame. Doubles that come out of long
sums are rounded, so that two engines adding in another order agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsieve import config
from tagsieve.functions import scores, text
from tagsieve.operators import chunks, labels, metrics, scoring, similarity, split
from tagsieve.operators import reports as report_ops
from tagsieve.operators import reviews as review_ops
from tagsieve.plans import analyze as analyze_plan
from tagsieve.plans import training
from tagsieve.session import fresh_folder, stored
from tagsieve.sources import reports as report_files
from tagsieve.sources import sinks, tables
from workload import inputs

REVIEWED_AT = "2024-05-06 07:08:09"


def round6(value: Column) -> Column:
    return F.rint(value * 1e6) / 1e6


# Sources


def read_quotations(spark, sf_dir):
    return inputs.annotated(spark, sf_dir)


def _extension() -> Column:
    return (
        F.when(F.col("lang") == "en", "TXT")
        .when(F.col("lang") == "fr", "txt")
        .when(F.col("lang") == "de", "doc")
        .otherwise("pdf")
    )


def report_intake(spark, sf_dir):
    """Documents as files with an extension by language; reports and rejections together."""
    path = F.concat(F.lit("in/report.v"), F.col("doc_id").cast("string"), F.lit("."), _extension())
    files = inputs.table(spark, sf_dir, "documents").select(
        path.alias("path"), F.encode("text", "UTF-8").alias("content")
    )
    result = report_files.intake(files)
    return result.reports.select(
        F.col("doc_id").alias("path"), "nome", "texto", F.lit(None).cast("string").alias("reason")
    ).unionByName(
        result.rejected.select(
            "path", F.lit(None).cast("string").alias("nome"), F.lit(None).cast("string").alias("texto"), "reason"
        )
    )


def _docx_files(spark, sf_dir) -> DataFrame:
    """Documents packed as .docx files, one paragraph per line."""

    def pack(batches):
        import io
        import zipfile
        from xml.sax.saxutils import escape

        import pandas as pd

        # Fixed value: the namespace of word-processing documents.
        space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"

        def docx(body):
            lines = "".join(
                f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in body.split("\n")
            )
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as package:
                package.writestr(
                    "word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{lines}</w:body></w:document>'
                )
            return out.getvalue()

        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "content": [docx(body) for body in batch["text"]]})

    documents = inputs.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), "text"
    )
    return documents.mapInPandas(pack, "path string, content binary")


def read_docx(spark, sf_dir):
    """Documents packed as .docx files and read back."""
    return report_files.intake(_docx_files(spark, sf_dir)).reports.select("nome", "texto")


def _docx_bomb(spark) -> DataFrame:
    """A small .docx file that unpacks to more than the intake allows."""
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package, package.open("word/document.xml", "w") as part:
        part.write(b"<w:document>")
        for _ in range(config.MAX_DOCX_BYTES >> 20):
            part.write(b"<w:p/> " * (1 << 18))
    return spark.createDataFrame([("in/bomb.docx", bytearray(out.getvalue()))], "path string, content binary")


def docx_intake(spark, sf_dir):
    """The same files, every fifth cut in half and every seventh without content, and one that unpacks to
    far more than its size: the sound ones are read, the others listed with a reason."""
    number = F.regexp_extract("path", "([0-9]+)", 1).cast("bigint")
    half = F.expr("substring(content, 1, cast(octet_length(content) / 2 as int))")
    content = F.when(number % 7 == 0, F.lit(b"")).when(number % 5 == 0, half).otherwise(F.col("content"))
    damaged = _docx_files(spark, sf_dir).select("path", content.alias("content"))
    result = report_files.intake(damaged.unionByName(_docx_bomb(spark)))
    nothing = F.lit(None).cast("string")
    return result.reports.select(F.col("doc_id").alias("path"), "texto", F.lit(False).alias("rejected")).unionByName(
        result.rejected.select("path", nothing.alias("texto"), F.col("reason").isNotNull().alias("rejected"))
    )


def read_reports(spark, sf_dir):
    """Documents written as text files, one folder per source, and read back as whole reports; every
    document ends with a line break there. The sum of line digests compares the texts."""
    folder = f"{fresh_folder(spark)}/reports"
    lines = inputs.table(spark, sf_dir, "documents").select("source", F.col("text").alias("value"))
    lines.write.partitionBy("source").option("compression", "none").text(folder)
    found = report_files.read_folder(spark, folder).reports
    read = F.slice(F.split("texto", "\n"), F.lit(1), F.size(F.split("texto", "\n")) - 1)
    digest = F.conv(F.substring(F.md5(F.col("line").cast("binary")), 1, 8), 16, 10).cast("bigint")
    source = F.regexp_extract("doc_id", "source=([^/]*)/", 1).alias("source")
    return (
        found.select(source, F.explode(read).alias("line"))
        .groupBy("source")
        .agg(
            F.sum(F.length("line").cast("bigint") + 1).alias("n_chars"),
            F.count(F.lit(1)).alias("n_lines"),
            F.sum(digest).alias("digest"),
        )
    )


def label_vocab(spark, sf_dir):
    """Tag list of the annotated quotations, stored as lines and read as a vocabulary."""
    tagged = labels.with_tags(labels.clean_quotations(inputs.annotated(spark, sf_dir)))
    vocab = labels.tag_frequency(tagged).agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    lines = vocab.select(F.concat(F.lit("\n  "), F.array_join("tags", " \r\n\n")).alias("value"))
    return tables.label_lines(lines)


# Text to rows


def paragraphs(spark, sf_dir):
    return chunks.report_paragraphs(inputs.spaced_reports(spark, sf_dir))


def report_chunks(spark, sf_dir):
    return chunks.report_chunks(chunks.spread(inputs.reports(spark, sf_dir)))


def paragraph_chunks(spark, sf_dir):
    """Chunks of reports that consist of many paragraphs."""
    return chunks.report_chunks(inputs.spaced_reports(spark, sf_dir))


def chunk_counts(spark, sf_dir):
    return chunks.chunk_counts(inputs.spaced_reports(spark, sf_dir))


def tokens(spark, sf_dir):
    return chunks.term_counts(chunks.spread(inputs.reports(spark, sf_dir)), ["doc_id"], "texto")


def ngrams(spark, sf_dir):
    return chunks.term_counts(chunks.spread(inputs.reports(spark, sf_dir)), ["doc_id"], "texto", bigrams=True)


def tag_lists(spark, sf_dir):
    tagged = labels.with_tags(inputs.annotated(spark, sf_dir))
    return tagged.select("ref_pos", F.array_join("tags", config.TAG_SEPARATOR).alias("tags"))


# Similarity


def term_idf(spark, sf_dir):
    refs = inputs.references(spark, sf_dir)
    return similarity.term_idf(inputs.reports(spark, sf_dir), refs).select(
        "doc_id", "trecho_id", "term", "tf", "df_doc", "df_ref", round6(F.col("idf")).alias("idf")
    )


def chunk_norms(spark, sf_dir):
    refs = inputs.references(spark, sf_dir)
    return similarity.chunk_norms(similarity.term_idf(inputs.reports(spark, sf_dir), refs)).select(
        "doc_id", "trecho_id", round6(F.col("norm")).alias("norm")
    )


def similarity_pairs(spark, sf_dir):
    """Pairs down to the lowest threshold a user may choose."""
    refs = inputs.references(spark, sf_dir)
    return similarity.similarity_pairs(inputs.reports(spark, sf_dir), refs, 0.05).select(
        "doc_id", "trecho_id", "ref_pos", round6(F.col("sim")).alias("sim")
    )


def nearest_reference(spark, sf_dir):
    refs = inputs.references(spark, sf_dir)
    return similarity.nearest_reference(inputs.reports(spark, sf_dir), refs).select(
        "doc_id", "trecho_id", text.round4(F.col("sim")).alias("sim"), "ref_pos"
    )


def candidates(spark, sf_dir):
    return analyze_plan.find_candidates(inputs.reports(spark, sf_dir), inputs.references(spark, sf_dir))


# Analysis and results


def analyze(spark, sf_dir):
    return analyze_plan.ordered(inputs.results(spark, sf_dir)).drop("probs")


def results(spark, sf_dir):
    """The result rows with their probabilities, one row per tag."""
    found = inputs.results(spark, sf_dir)
    listed = found.select("arquivo", "trecho_id", "similaridade", F.posexplode("probs").alias("idx", "prob"))
    names = F.array(*[F.lit(tag) for tag in inputs.LABELS])
    return listed.select(
        "arquivo",
        "trecho_id",
        "similaridade",
        "idx",
        F.get(names, F.col("idx")).alias("tag"),
        text.round4(F.col("prob")).alias("prob"),
    )


def results_tagged(spark, sf_dir):
    return report_ops.results_table(inputs.results(spark, sf_dir))


def results_by_file(spark, sf_dir):
    """One report, untagged chunks included: the first by name among those with results."""
    results = stored(inputs.results(spark, sf_dir))
    first = results.agg(F.min("arquivo")).scalar()
    return report_ops.results_table(results.filter(F.col("arquivo") == first), only_tagged=False)


def report_names(spark, sf_dir):
    return report_ops.report_names(inputs.results(spark, sf_dir))


def top20(spark, sf_dir):
    return report_ops.first_rows(inputs.results(spark, sf_dir)).select(
        "arquivo", "trecho_id", "tags_preditas", "confianca"
    )


def result_summary(spark, sf_dir):
    summary = report_ops.result_summary(inputs.results(spark, sf_dir))
    return summary.select("n_trechos", "n_revisar", round6(F.col("confianca_media")).alias("confianca_media"))


def report_coverage(spark, sf_dir):
    return report_ops.report_coverage(inputs.reports(spark, sf_dir), inputs.results(spark, sf_dir))


def report_status(spark, sf_dir):
    reports = inputs.reports(spark, sf_dir)
    found = similarity.chosen(reports, inputs.references(spark, sf_dir))
    return report_ops.report_status(chunks.chunk_counts(chunks.dealt(reports)), found)


def report_tag_counts(spark, sf_dir):
    return report_ops.report_tag_counts(inputs.results(spark, sf_dir))


def taxonomy(spark, sf_dir):
    """The taxonomy in display order with the number of chunks tagged so."""
    used = report_ops.report_tag_counts(inputs.results(spark, sf_dir), ["doc_id"]).groupBy("tag").agg(F.sum("n").alias("n"))
    listed = tables.taxonomy(spark)
    return listed.join(used.withColumnRenamed("tag", "full_tag"), "full_tag", "left").select(
        "block_pos", "block", "tag_pos", "tag", "full_tag", F.coalesce("n", F.lit(0)).alias("n")
    )


def absent_tags(spark, sf_dir):
    known = inputs.label_frequencies(spark, sf_dir)
    return report_ops.absent_tags(inputs.results(spark, sf_dir), known)


def brief_evidence(spark, sf_dir):
    return report_ops.brief_evidence(inputs.results(spark, sf_dir))


def _brief(spark, sf_dir, group):
    return report_ops.brief_inputs(
        inputs.results(spark, sf_dir), inputs.label_frequencies(spark, sf_dir), group
    )


def brief_inputs(spark, sf_dir):
    return _brief(spark, sf_dir, report_ops.REPORT).select(
        "doc_id",
        "arquivo",
        "n_total",
        "n_revisar",
        F.array_join(
            F.transform("tags", lambda t: F.concat(t.tag, F.lit("="), t.n.cast("string"))), ";"
        ).alias("tags"),
        F.array_join("ausentes", ";").alias("ausentes"),
        F.array_join(
            F.transform(
                "evidencias",
                lambda e: F.concat(e.tags_preditas, F.lit("="), e.confianca_pct, F.lit("="), e.trecho),
            ),
            ";",
        ).alias("evidencias"),
    )


def brief_text(spark, sf_dir):
    briefs = _brief(spark, sf_dir, report_ops.REPORT)
    return report_ops.brief_text(briefs, F.col("arquivo")).select("arquivo", "texto")


def brief_all(spark, sf_dir):
    """All reports as one group."""
    return report_ops.brief_text(_brief(spark, sf_dir, []), F.lit("all")).select("n_total", "n_revisar", "texto")


# Review loop


def review_queue(spark, sf_dir):
    queue = review_ops.review_queue(inputs.results(spark, sf_dir), tables.full_tags())
    return queue.withColumn("tags_corrigidas", F.array_join("tags_corrigidas", config.TAG_SEPARATOR))


def _edited(spark, sf_dir) -> DataFrame:
    """The annotated quotations as an edited review table: toxic ones are to be included."""
    tagged = labels.with_tags(inputs.annotated(spark, sf_dir))
    return tagged.select(
        F.col("quotation").alias("trecho"),
        F.array_remove(F.array_remove("tags", "quality 0"), "quality 1").alias("tags_corrigidas"),
        F.array_contains("tags", "toxic 1").alias("incluir_no_treino"),
    )


def append_reviews(spark, sf_dir):
    stored = inputs.reviews(spark, sf_dir).select(
        F.nullif(F.col("quotation"), F.lit("")).alias("quotation"),
        "codes",
        F.lit("2024-01-01 00:00").alias("data_revisao"),
    )
    new = review_ops.accepted_corrections(_edited(spark, sf_dir), REVIEWED_AT)
    return review_ops.append_reviews(stored, new)


def upsert_reviews(spark, sf_dir):
    tagged = labels.with_tags(inputs.annotated(spark, sf_dir))
    pairs = tagged.filter(F.array_contains("tags", "toxic 1")).select(
        F.col("ref_pos").alias("seq"), F.col("quotation").alias("trecho"), "tags"
    )
    return review_ops.upsert_reviews(inputs.reviews(spark, sf_dir), pairs)


def review_loop(spark, sf_dir):
    """Corrections accepted twice, appended to a stored table that only has numbers, compacted in between, read
    back where they lie and put on top of the annotations."""
    folder = fresh_folder(spark)
    name = f"reviews_{folder.rsplit('-', 1)[1]}"
    sinks.append_to_review_table(inputs.reviews(spark, sf_dir), name, f"{folder}/reviews", 8)
    edited = _edited(spark, sf_dir)
    sinks.append_to_review_table(review_ops.accepted_corrections(edited, REVIEWED_AT), name, f"{folder}/reviews", 8)
    sinks.compact_review_table(spark, name, f"{name}_c", f"{folder}/compacted", 8)
    again = edited.filter(F.array_contains("tags_corrigidas", "en")).withColumn(
        "tags_corrigidas", F.concat("tags_corrigidas", F.array(F.lit("again")))
    )
    sinks.append_to_review_table(
        review_ops.accepted_corrections(again, REVIEWED_AT), f"{name}_c", f"{folder}/compacted", 8
    )
    base = labels.training_base_in_place(inputs.annotated(spark, sf_dir), spark.table(f"{name}_c"))
    return base.select("quotation", "codes")


def review_version(spark, sf_dir):
    """The stored new version of the corrections, with the number of pairs saved."""
    tagged = labels.with_tags(inputs.annotated(spark, sf_dir))
    pairs = tagged.filter(F.array_contains("tags", "toxic 1")).select(
        F.col("ref_pos").alias("seq"), F.col("quotation").alias("trecho"), "tags"
    )
    path = f"{fresh_folder(spark)}/reviews"
    saved = sinks.write_review_version(inputs.reviews(spark, sf_dir), pairs, path)
    return spark.read.parquet(path).withColumn("saved", F.lit(saved).cast("bigint"))


# Training data


def clean_quotations(spark, sf_dir):
    """Quotations where every low-quality code cell is the word of a missing cell."""
    cells = inputs.annotated(spark, sf_dir)
    blanked = F.when(F.col("codes").contains("quality 0"), F.lit("nan")).otherwise(F.col("codes"))
    return labels.clean_quotations(cells.withColumn("codes", blanked))


def _base(spark, sf_dir) -> DataFrame:
    return labels.training_base(inputs.annotated(spark, sf_dir), inputs.reviews(spark, sf_dir))


def _tagged(spark, sf_dir) -> DataFrame:
    return labels.with_tags(_base(spark, sf_dir))


def _set(spark, sf_dir) -> training.TrainingSet:
    return training.training_set(inputs.annotated(spark, sf_dir), inputs.reviews(spark, sf_dir))


def training_base(spark, sf_dir):
    return _base(spark, sf_dir)


def tag_frequency(spark, sf_dir):
    return labels.by_frequency(labels.tag_frequency(_tagged(spark, sf_dir)))


def tag_vocab(spark, sf_dir):
    return labels.label_vocab(labels.tag_frequency(_tagged(spark, sf_dir)).select("tag"))


def rare_tags(spark, sf_dir):
    frequency = labels.tag_frequency(_tagged(spark, sf_dir))
    rare = labels.rare_tags(frequency).withColumn("kept", F.lit(False))
    return rare.unionByName(labels.frequent_tags(frequency).withColumn("kept", F.lit(True)))


def rows_after_rare(spark, sf_dir):
    tagged = _tagged(spark, sf_dir)
    kept = labels.keep_tags(tagged, labels.frequent_tags(labels.tag_frequency(tagged)))
    return kept.select("row_id", F.array_join("tags", config.TAG_SEPARATOR).alias("tags"))


def label_matrix(spark, sf_dir):
    tagged = _tagged(spark, sf_dir)
    vocab = labels.label_vocab(labels.frequent_tags(labels.tag_frequency(tagged)).select("tag"))
    return labels.label_matrix(tagged, vocab)


def tag_split(spark, sf_dir):
    return _set(spark, sf_dir).rows.select("row_id", "is_test")


def random_split(spark, sf_dir):
    rows = stored(_base(spark, sf_dir).select("row_id"))
    return split.random_split(rows)


def training_set(spark, sf_dir):
    data = _set(spark, sf_dir)
    return data.rows.select(
        "row_id", "quotation", F.array_join("tags", config.TAG_SEPARATOR).alias("tags"), "is_test"
    )


def untrained_tags(spark, sf_dir):
    """Tags that no row of the training part of a random split carries."""
    tagged = stored(_tagged(spark, sf_dir))
    vocab = labels.label_vocab(labels.tag_frequency(tagged).select("tag"))
    train = split.random_split(tagged).filter(~F.col("is_test"))
    return labels.untrained_tags(train, vocab)


def _counts(spark, sf_dir) -> DataFrame:
    data = _set(spark, sf_dir)
    return labels.label_counts(data.train, data.vocab)


def pos_weight(spark, sf_dir):
    return labels.pos_weight(_counts(spark, sf_dir)).withColumn("pos_weight", round6(F.col("pos_weight")))


def class_weight(spark, sf_dir):
    return labels.class_weight(_counts(spark, sf_dir)).select(
        "idx", "tag", round6(F.col("weight_pos")).alias("weight_pos"), round6(F.col("weight_neg")).alias("weight_neg")
    )


def top_terms(spark, sf_dir):
    return training.top_terms(_base(spark, sf_dir))


def tfidf_features(spark, sf_dir):
    rows = _base(spark, sf_dir)
    features = training.feature_rows(training.fit_features(rows), rows)
    return features.withColumn("weight", round6(F.col("weight")))


def vectorizer_files(spark, sf_dir):
    """The features of ``tfidf_features`` from a vectorizer that was stored and loaded again."""
    rows = _base(spark, sf_dir)
    folder = fresh_folder(spark)
    training.save_model(inputs.fixed_model(spark, sf_dir), folder, training.fit_features(rows))
    features = training.feature_rows(training.load_features(folder), rows)
    return features.withColumn("weight", round6(F.col("weight")))


def _trained(spark, sf_dir) -> training.Trained:
    return training.train_and_report(inputs.annotated(spark, sf_dir), inputs.reviews(spark, sf_dir), fresh_folder(spark))


def train_lr(spark, sf_dir):
    """Train on the training part: for each tag, the rows, and whether the stored coefficients are where
    the gradient of the objective is as small as the tolerance asks."""
    trained = _trained(spark, sf_dir)
    folder = trained.paths["classificador"].rsplit("/", 1)[0]
    return training.optimality(
        trained.data.train, trained.data.vocab, training.load_model(spark, folder), config.LR_TOLERANCE
    )


#: The stored scores of a test part, restated in SQL: what the stored F1 must be.
F1_SQL = """
WITH said AS (SELECT idx, truth, prob >= 0.5 AS said FROM {scores}),
tags AS (
  SELECT idx, count_if(truth AND said) AS tp, count_if(truth) AS n_true, count_if(said) AS n_said FROM said GROUP BY idx),
each AS (SELECT *, CASE WHEN n_true + n_said > 0 THEN 2 * tp / (n_true + n_said) ELSE 0 END AS f1 FROM tags)
SELECT avg(f1) AS f1_macro, 2 * sum(tp) / (sum(n_true) + sum(n_said)) AS f1_micro,
       sum(n_true * f1) / sum(n_true) AS f1_weighted FROM each
"""


def train_f1(spark, sf_dir):
    """Train on the training part, score and store the test part, store F1: for each tag the scored test rows and
    those that carry it, whether the stored F1 follow from the stored scores, and whether the
    model beats saying every tag of every row."""
    trained = _trained(spark, sf_dir)
    scored = spark.read.parquet(trained.paths["avaliacao"])
    stated = spark.sql(F1_SQL.format(scores="{scores}"), scores=scored).first()
    always = spark.sql(F1_SQL.format(scores="{scores}"), scores=scored.withColumn("prob", F.lit(1.0))).first()
    stored_f1 = trained.metrics.first()
    same = all(abs(stated[name] - stored_f1[name]) < 1e-9 for name in ("f1_macro", "f1_micro", "f1_weighted"))
    return scored.groupBy("idx", "tag").agg(
        F.count(F.lit(1)).alias("n_test"),
        F.count_if("truth").alias("n_true"),
        F.lit(same).alias("f1_stored"),
        F.lit(bool(stored_f1["f1_micro"] > always["f1_micro"])).alias("f1_better"),
    )


def run_stats(spark, sf_dir):
    data = _set(spark, sf_dir)
    reports = chunks.chunk_counts(inputs.spaced_reports(spark, sf_dir))
    sizes = data.rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum((~F.col("is_test")).cast("bigint")).alias("n_train"),
        F.sum(F.col("is_test").cast("bigint")).alias("n_test"),
    )
    # both sums in one value, so that texts are cut once
    cut = reports.agg(F.struct(F.sum("n_paragrafos").alias("n_paragrafos"), F.sum("n_trechos").alias("n_trechos"))).scalar()
    counted = sizes.select("*", data.vocab.agg(F.count(F.lit(1))).scalar().alias("n_tags"), cut.alias("cut"))
    return counted.select("n_rows", "n_train", "n_test", "n_tags", "cut.n_paragrafos", "cut.n_trechos")


# Scores


def linear_scores(spark, sf_dir):
    """Every document scored with the fixed model, one row per tag."""
    return _quotation_scores(spark, sf_dir, inputs.fixed_model(spark, sf_dir))


def model_files(spark, sf_dir):
    """The same after storing the model and loading it again."""
    folder = fresh_folder(spark)
    training.save_model(inputs.fixed_model(spark, sf_dir), folder)
    return _quotation_scores(spark, sf_dir, training.load_model(spark, folder))


def _quotation_scores(spark, sf_dir, model: scoring.LinearModel) -> DataFrame:
    rows = chunks.spread(inputs.reports(spark, sf_dir)).select(
        "doc_id", F.lit(1).alias("trecho_id"), F.col("texto").alias("trecho")
    )
    scored = scoring.classify(scoring.score_linear(rows, model), model.tags)
    return scoring.long_scores(scored, model.tags).select(
        "doc_id", "trecho_id", "idx", "tag", round6(F.col("prob")).alias("prob")
    )


def _classified(spark, sf_dir) -> DataFrame:
    return scoring.classify(inputs.vector_logits(spark, sf_dir), inputs.VECTOR_TAGS)


def sigmoid_scores(spark, sf_dir):
    logits = inputs.vector_logits(spark, sf_dir)
    probs = logits.select("doc_id", F.posexplode(scores.probabilities(F.col("logits"))).alias("idx", "prob"))
    return probs.select("doc_id", "idx", round6(F.col("prob")).alias("prob"))


def decode_scores(spark, sf_dir):
    return _classified(spark, sf_dir).select("doc_id", "tags_preditas", "confianca", "numero_tags", "revisar")


def wide_scores(spark, sf_dir):
    return scoring.wide_scores(_classified(spark, sf_dir).drop("label", "trecho_id", "tags_preditas"), inputs.VECTOR_TAGS)


def batch_scores(spark, sf_dir):
    """A plug-in model: logits from text length and three vowels, decoded as usual."""

    def make_predict():
        import numpy as np

        def predict(texts):
            counts = [[len(t) / 600, *(t.lower().count(v) / 100 for v in "aei")] for t in texts]
            return np.array(counts, dtype=float) * 2.0 - 2.0

        return predict

    reports = chunks.spread(inputs.reports(spark, sf_dir))
    found = chunks.report_chunks(reports).select("doc_id", "trecho_id", "trecho")
    scored = scoring.score_batches(found, make_predict, batch_size=256)
    return scoring.classify(scored, ["long", "many a", "many e", "many i"]).select(
        "doc_id", "trecho_id", "tags_preditas", "confianca", "numero_tags", "revisar"
    )


def _truth(spark, sf_dir, name: str, factor: float) -> DataFrame:
    logits = inputs.vector_logits(spark, sf_dir).select(
        "label", F.posexplode(F.transform("logits", lambda x: scores.sigmoid(x * factor))).alias("idx", "prob")
    )
    return logits.select(F.lit(name).alias("model"), "idx", (F.col("label") == F.col("idx")).alias("truth"), "prob")


def _rounded_f1(scored: DataFrame, threshold: float) -> DataFrame:
    return metrics.f1_metrics(scored, threshold).select(
        "model", *[round6(F.col(name)).alias(name) for name in ("f1_macro", "f1_micro", "f1_weighted")]
    )


def f1_metrics(spark, sf_dir):
    return _rounded_f1(_truth(spark, sf_dir, "vectors", 1.0), 0.5)


def model_comparison(spark, sf_dir):
    """Two models on the same rows."""
    both = _truth(spark, sf_dir, "plain", 1.0).unionByName(_truth(spark, sf_dir, "sharp", 3.0))
    return _rounded_f1(both, 0.9)


# Sinks


def result_files(spark, sf_dir):
    """Results and frequencies written as two datasets, both read back, with the name they are under."""
    from datetime import datetime

    name = sinks.output_name(["a", "b"], datetime.fromisoformat(REVIEWED_AT))
    scored = _classified(spark, sf_dir).drop("label")
    paths = sinks.write_results(scored, inputs.label_frequencies(spark, sf_dir), fresh_folder(spark), name)
    names = {part: path.split("/")[-2:] for part, path in paths.items()}
    results = spark.read.parquet(paths["resultados"])
    whole, part = names["resultados"]
    rows = results.select(
        F.lit(whole).alias("nome"), F.lit(part).alias("parte"), F.col("doc_id").cast("string").alias("chave"),
        "tags_preditas", "confianca", F.col("numero_tags").cast("bigint").alias("numero"), "revisar",
        round6(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)).alias("soma"),
    )
    whole, part = names["frequencia_tags"]
    frequencies = spark.read.parquet(paths["frequencia_tags"]).select(
        F.lit(whole).alias("nome"), F.lit(part).alias("parte"), F.col("tag").alias("chave"),
        F.lit(None).cast("string").alias("tags_preditas"), F.lit(None).cast("double").alias("confianca"),
        F.col("n").alias("numero"), F.lit(None).cast("boolean").alias("revisar"), F.lit(None).cast("double").alias("soma"),
    )
    return rows.unionByName(frequencies)


def result_csv(spark, sf_dir):
    """Results with a list column and the texts written as CSV and read back, line breaks and quotes included."""
    results = inputs.results(spark, sf_dir).select(
        "doc_id", "trecho_id", "trecho", "confianca", "revisar",
        F.split("tags_preditas", r" \| ").alias("tags"),
    )
    path = sinks.write_csv(results, fresh_folder(spark), "resultado")
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    kinds = "doc_id bigint, trecho_id int, trecho string, confianca double, revisar boolean, tags string"
    return reader.schema(kinds).csv(path)


def label_files(spark, sf_dir):
    """Label list, frequencies and removed tags written next to a model and read back."""
    data = _set(spark, sf_dir)
    paths = sinks.write_label_tables(fresh_folder(spark), data.vocab, data.frequencies, data.removed)
    vocab = spark.read.parquet(paths["labels"])
    found = spark.read.parquet(paths["frequencia_tags"])
    if "tags_removidas" in paths:
        found = found.unionByName(spark.read.parquet(paths["tags_removidas"]))
    return found.join(vocab, "tag", "left").select("tag", "n", F.coalesce("idx", F.lit(-1)).alias("idx"))


QUERIES = {
    "analyze": analyze,
    "read_quotations": read_quotations,
    "read_reports": read_reports,
    "read_docx": read_docx,
    "docx_intake": docx_intake,
    "report_intake": report_intake,
    "label_vocab": label_vocab,
    "clean_quotations": clean_quotations,
    "paragraphs": paragraphs,
    "chunks": report_chunks,
    "paragraph_chunks": paragraph_chunks,
    "chunk_counts": chunk_counts,
    "tokens": tokens,
    "ngrams": ngrams,
    "tag_lists": tag_lists,
    "term_idf": term_idf,
    "chunk_norms": chunk_norms,
    "similarity_pairs": similarity_pairs,
    "nearest_reference": nearest_reference,
    "candidates": candidates,
    "results": results,
    "results_tagged": results_tagged,
    "results_by_file": results_by_file,
    "report_names": report_names,
    "top20": top20,
    "result_summary": result_summary,
    "report_coverage": report_coverage,
    "report_status": report_status,
    "report_tag_counts": report_tag_counts,
    "taxonomy": taxonomy,
    "absent_tags": absent_tags,
    "brief_evidence": brief_evidence,
    "brief_inputs": brief_inputs,
    "brief_text": brief_text,
    "brief_all": brief_all,
    "review_queue": review_queue,
    "append_reviews": append_reviews,
    "upsert_reviews": upsert_reviews,
    "review_loop": review_loop,
    "review_version": review_version,
    "training_base": training_base,
    "tag_frequency": tag_frequency,
    "tag_vocab": tag_vocab,
    "rare_tags": rare_tags,
    "rows_after_rare": rows_after_rare,
    "label_matrix": label_matrix,
    "split": tag_split,
    "random_split": random_split,
    "training_set": training_set,
    "untrained_tags": untrained_tags,
    "pos_weight": pos_weight,
    "class_weight": class_weight,
    "top_terms": top_terms,
    "tfidf_features": tfidf_features,
    "train_lr": train_lr,
    "train_f1": train_f1,
    "vectorizer_files": vectorizer_files,
    "run_stats": run_stats,
    "linear_scores": linear_scores,
    "model_files": model_files,
    "sigmoid_scores": sigmoid_scores,
    "decode_scores": decode_scores,
    "wide_scores": wide_scores,
    "batch_scores": batch_scores,
    "f1_metrics": f1_metrics,
    "model_comparison": model_comparison,
    "result_files": result_files,
    "result_csv": result_csv,
    "label_files": label_files,
}
