"""Naive Bayes as grouped counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions.blas import one_thread
from gaugework.functions.text import count_tokens, explode_tokens
from gaugework.lineage import cut_lineage


def text_bayes(docs: DataFrame, text: str, label: str, smoothing: float = 1.0) -> DataFrame:
    """Smoothed log probability ``(label, word, n, log_p)`` of every word seen with a label.

    Words never seen with a label share ``log(smoothing / (words of the label + smoothing * vocabulary))``,
    given by :func:`text_bayes_labels`.
    """
    counts = _word_counts(docs, text, label)
    totals = _label_totals(counts, smoothing)
    log_p = F.log((F.col("n") + smoothing) / F.col("_total"))
    return counts.join(totals, "label").select("label", "word", "n", log_p.alias("log_p"))


def text_bayes_labels(docs: DataFrame, text: str, label: str, smoothing: float = 1.0) -> DataFrame:
    """Per label: documents, log prior and the log probability of an unseen word."""
    priors = docs.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("docs"))
    all_docs = priors.agg(F.sum("docs").alias("_docs"))
    totals = _label_totals(_word_counts(docs, text, label), smoothing)
    return (
        priors.join(totals, "label")
        .withColumn("log_prior", F.log(F.col("docs") / all_docs.scalar()))
        .select("label", "docs", "log_prior", F.log(F.lit(smoothing) / F.col("_total")).alias("log_p_unseen"))
    )


def _word_counts(docs: DataFrame, text: str, label: str) -> DataFrame:
    """Counts per label and word, written once: the totals read them instead of the text."""
    return cut_lineage(
        explode_tokens(docs, text, F.col(label).alias("label"))
        .groupBy("label", "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _label_totals(counts: DataFrame, smoothing: float) -> DataFrame:
    """Words per label plus the smoothing mass of the vocabulary. One row per label."""
    vocabulary = counts.agg(F.countDistinct("word"))
    return counts.groupBy("label").agg((F.sum("n")).alias("_n")).select(
        "label", (F.col("_n") + F.lit(smoothing) * vocabulary.scalar()).alias("_total")
    )


def text_bayes_score(model: DataFrame, labels: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Log score ``(doc, label, score)`` of each text under the exact model of :func:`text_bayes`.

    Only words of the model's vocabulary count; those it never saw with a label get the unseen-word value.
    """
    # counted per row; rows of one id add up in the sums
    seen = count_tokens(docs, text, F.col(doc_id))
    # one entry per label that has the word, so the lists are as short as the labels are few
    by_word = model.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("label", "log_p"))).alias("_log_p"))
    fields = ("label", "log_prior", "log_p_unseen")
    each_label = F.explode(
        F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in fields]) for r in labels.select(*fields).collect()])
    )
    log_p = F.coalesce(F.try_element_at("_log_p", F.col("_l.label")), F.col("_l.log_p_unseen"))
    sums = (
        seen.join(by_word, "word")
        .select("doc", "tf", "_log_p", each_label.alias("_l"))
        .groupBy("doc", F.col("_l.label").alias("label"))
        .agg(F.sum(F.col("tf") * log_p).alias("_sum"))
    )
    base = docs.select(F.col(doc_id).alias("doc"), each_label.alias("_l")).select("doc", "_l.label", "_l.log_prior")
    return base.join(sums, ["doc", "label"], "left").select(
        "doc", "label", (F.col("log_prior") + F.coalesce("_sum", F.lit(0.0))).alias("score")
    )


def text_bayes_predict(train: DataFrame, test: DataFrame, doc_id: str, text: str, label: str, smoothing: float = 1.0) -> DataFrame:
    """The likeliest label of the texts of ``test`` under the exact model, ``prediction``; all words of ``train`` count, and
    of equal scores (to nine decimals) the smaller label wins."""
    model, labels = text_bayes(train, text, label, smoothing), text_bayes_labels(train, text, label, smoothing)
    scores = text_bayes_score(model, labels, test, doc_id, text)
    best = F.max_by("label", F.struct(F.round("score", 9), -F.col("label")))
    found = scores.groupBy("doc").agg(best.alias("prediction")).withColumnRenamed("doc", doc_id)
    return test.join(found, doc_id)


def naive_bayes(df: DataFrame, features: list[str], label: str, smoothing: float = 1.0) -> DataFrame:
    """Multinomial model ``(label, feature, log_prior, log_p)`` on non-negative feature columns.

    One grouped sum per feature; the result has one row per label and feature.
    """
    sums = df.groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).cast("double").alias(c) for c in features]
    )
    rows = sums.agg(F.sum("_rows"))
    total = sum((F.col(c) for c in features), F.lit(smoothing * len(features)))
    return (
        sums.withColumn("_total", total)
        .withColumn("log_prior", F.log(F.col("_rows") / rows.scalar()))
        .unpivot(["label", "log_prior", "_total"], features, "feature", "_sum")
        .select("label", "feature", "log_prior", F.log((F.col("_sum") + smoothing) / F.col("_total")).alias("log_p"))
    )


#: Numbers of a label's sums that travel as one piece.
SUM_BLOCK = 1 << 14


def naive_bayes_array(df: DataFrame, features: str, label: str, smoothing: float = 1.0) -> DataFrame:
    """Multinomial model ``(label, first, log_prior, log_p)`` on an array column of any width, in pieces of ``SUM_BLOCK`` features
    from feature ``first`` (0) on.

    A task emits one sum per label and feature, as vectors; the pieces are added up in the order in which they compare, so
    that whole numbers stay exact. Rows with a null label or array, or a null in it, are left out; a number below 0 is an error.
    """
    values = F.col(features).cast("array<double>")
    rows = df.select(F.col(label).alias("label"), values.alias("x")).where("label is not null and x is not null and not exists(x, v -> v is null)")
    kind = rows.schema["label"].dataType.simpleString()

    def partial(batches):
        import numpy as np
        import pyarrow as pa

        sums = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if (x < 0).any():
                raise ValueError("a feature below 0")
            names = batch.column(0).to_pylist()
            found = {name: k for k, name in enumerate(dict.fromkeys(names))}
            total = np.zeros((len(found), x.shape[1] + 1))
            np.add.at(total, [found[name] for name in names], np.hstack([x, np.ones((len(x), 1))]))
            for name, k in found.items():
                sums[name] = sums[name] + total[k] if name in sums else total[k]
        for name, total in sums.items():
            firsts = list(range(0, len(total) - 1, SUM_BLOCK))
            pieces = [total[a : min(a + SUM_BLOCK, len(total) - 1)].tolist() for a in firsts]
            made = [pa.array([name] * len(firsts), batch_type), pa.array(firsts, pa.int32()), pa.array([int(total[-1])] * len(firsts), pa.int64()), pa.array(pieces, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(made, ["label", "first", "n", "sums"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(rows.schema["label"].dataType)
    schema = f"label {kind}, first int, n long, sums array<double>"

    def add(key, table):
        import numpy as np
        import pyarrow as pa

        pieces = sorted(table.column("sums").to_pylist())
        total = np.sum(np.array(pieces), axis=0)
        n = sum(table.column("n").to_pylist())
        return pa.table([pa.array([key[0].as_py()], batch_type), pa.array([key[1].as_py()], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tolist()])], names=["label", "first", "n", "sums"])

    added = cut_lineage(rows.mapInArrow(partial, schema).groupBy("label", "first").applyInArrow(add, schema))
    mass = F.aggregate("sums", F.lit(0.0), lambda s, x: s + x)
    totals = added.groupBy("label").agg(F.max("n").alias("_n"), F.sum(mass).alias("_mass"), F.sum(F.size("sums")).alias("_width"))
    rows_in_all = totals.agg(F.sum("_n"))
    named = added.join(totals, "label")
    logs = F.transform("sums", lambda x: F.log((x + smoothing) / (F.col("_mass") + smoothing * F.col("_width"))))
    return named.select("label", "first", F.log(F.col("_n") / rows_in_all.scalar()).alias("log_prior"), logs.alias("log_p"))


def naive_bayes_predict(df: DataFrame, model: DataFrame, features: str) -> DataFrame:
    """The rows with ``prediction``, the likeliest label (the smallest of equals); a null array, or a null in it, has none.

    The model goes to every task: one number per label and feature.
    """
    import numpy as np
    from pyspark.sql.pandas.types import to_arrow_type

    parts = model.orderBy("label", "first").collect()
    labels = list(dict.fromkeys(r["label"] for r in parts))
    weights = np.array([np.concatenate([r["log_p"] for r in parts if r["label"] == name]) for name in labels])
    priors = np.array([next(r["log_prior"] for r in parts if r["label"] == name) for name in labels])
    shared = df.sparkSession.sparkContext.broadcast((labels, weights, priors))
    keep, kind = df.columns, model.schema["label"].dataType
    schema = df.select("*", F.lit(None).cast(kind).alias("prediction")).schema
    values = F.col(features).cast("array<double>")
    whole = F.when(~F.exists(values, lambda x: x.isNull()), values)
    arrow = to_arrow_type(kind)

    def run(batches):
        import pyarrow as pa

        one_thread()
        names, table, prior = shared.value
        for batch in batches:
            column = batch.column(len(keep))
            known, found = column.is_valid().to_numpy(zero_copy_only=False), [None] * batch.num_rows
            if known.any() and names:
                own = column.filter(pa.array(known))
                x = own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                for row, best in zip(np.flatnonzero(known), (x @ table.T + prior).argmax(axis=1)):
                    found[row] = names[best]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, arrow)], [*keep, "prediction"])

    return df.select(*keep, whole.alias("_features")).mapInArrow(run, schema)
