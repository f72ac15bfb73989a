"""The classical experiment as Spark jobs (I1, I4, I5, I10-I12, C1, C4, G3u, B10).

Runs = intra (per dataset and seed, stratified 80/20) and cross (train on one
whole dataset, test on another), each scored on the original, masked and
removed test text. The reference refits per variant; here each distinct
training set is fitted once and every variant is scored against it. The naive
Bayes keeps all sets of a dataset as columns of one table (operators/naive_bayes.py);
results and the Spark ML models name a set by ``tset``:

* intra: ``<dataset>:<seed>`` (the train part of that seed's split)
* cross: ``<dataset>:all`` (same rows for every seed, so fitted once)

The relational naive Bayes runs end to end in one lazy plan; Spark ML models
(plans/ml.py) reuse the same split, vocabulary and weights.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SEEDS
from ..functions.text import trigger_hits
from ..operators import boosting, features, lexicon, linear_svm, naive_bayes, split
from ..session import materialize as _materialize
from ..sources.fixtures import DATASET_EVEN, DATASET_ODD

DEFAULT_CROSS = [(DATASET_EVEN, DATASET_ODD), (DATASET_ODD, DATASET_EVEN)]


def _cross_map(cross_pairs) -> F.Column:
    """test dataset -> array of train datasets (literal map, bounded by the pair list)."""
    by_test: dict[str, list[str]] = {}
    for tr, te in cross_pairs:
        by_test.setdefault(te, []).append(tr)
    kv = []
    for te, trs in by_test.items():
        kv += [F.lit(te), F.array(*[F.lit(t) for t in trs])]
    return F.create_map(*kv)


class ClassicalData:
    """Shared tables of one classical experiment: split, terms, training sets, vocabularies, test rows.

    Every table is made when it is first asked for; with ``materialize`` the
    ones that several plans read are written then, and read back.
    """

    def __init__(self, req: DataFrame, seeds=SEEDS, cross_pairs=DEFAULT_CROSS, materialize: bool = False):
        self._source, self.seeds, self.cross_pairs, self._written = req, list(seeds), list(cross_pairs), materialize
        self.sets = naive_bayes.SetColumns([*[str(s) for s in self.seeds], "all"])

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        return _materialize(df, name) if self._written else df

    @cached_property
    def req(self) -> DataFrame:
        return self._keep(self._source.select("req_id", "dataset", "requirement_text", "label", "reasons").withColumn(
            "hit", F.size(trigger_hits("requirement_text")) > 0), "req")

    @cached_property
    def terms(self) -> DataFrame:
        """(req_id, term, cnt) of the original texts."""
        original = self.req.select("req_id", "requirement_text")
        return self._keep(features.doc_terms(original, keys=("req_id",), ids=self.req.select("req_id")), "terms")

    @cached_property
    def _changed_terms(self) -> DataFrame:
        # A row where no lexicon form occurs has masked text == original and removed
        # text differing only in whitespace, so all three variants have the same terms:
        # only rows with a hit are tokenised (and later scored) per variant.
        changed = lexicon.text_variants(self.req.where("hit").select("req_id", "requirement_text")).where(
            F.col("variant") != "original").select("req_id", "variant", "scored_text")
        return self._keep(features.doc_terms(changed, keys=("req_id", "variant"), text="scored_text", ids=self.req.select("req_id")), "changed")

    @property
    def terms_v(self) -> DataFrame:
        return self.terms.select("req_id", F.lit("original").alias("variant"), "term", "cnt").unionByName(self._changed_terms)

    @property
    def _labelled(self) -> DataFrame:
        return self.req.select("req_id", "dataset", "label", "hit", "reasons")

    @cached_property
    def split(self) -> DataFrame:
        return self._keep(split.intra_split(self._labelled, self.seeds), "split")

    @cached_property
    def rows(self) -> DataFrame:
        """(req_id, dataset, label, in<k>): a row per text with a flag for each training set of its dataset."""
        trains = sorted({tr for tr, _ in self.cross_pairs})
        is_train = lambda s: (F.col("seed") == s) & (F.col("part") == "train")
        flags = [F.max(F.when(is_train(s), 1).otherwise(0)).alias(f"in{k}") for k, s in enumerate(self.seeds)]
        out = self.split.groupBy("req_id", "dataset", "label").agg(*flags)
        return self._keep(out.withColumn(f"in{len(self.seeds)}", F.col("dataset").isin(*trains).cast("int")), "rows")

    @property
    def train(self) -> DataFrame:
        """(tset, req_id, label): a row per training set that has the text (for fits of one set at a time)."""
        names = F.array(*[F.when(F.col(f"in{k}") == 1, F.concat_ws(":", "dataset", F.lit(s))) for k, s in enumerate(self.sets.sets)])
        return self.rows.select(F.explode(F.array_compact(names)).alias("tset"), "req_id", "label")

    @cached_property
    def labels(self) -> list:
        """The classes (a short list), in order."""
        return sorted(r[0] for r in self.rows.select("label").distinct().collect() if r[0] is not None)

    @cached_property
    def runs(self) -> DataFrame:
        intra_runs = self.split.where(F.col("part") == "test").select(
            F.lit("intra").alias("setting"), F.col("dataset").alias("train_dataset"),
            F.col("dataset").alias("test_dataset"), "seed", "req_id",
            F.concat_ws(":", "dataset", F.col("seed").cast("string")).alias("tset"), "hit", "label", "reasons",
        )
        cross_runs = (
            self._labelled.select("req_id", "hit", "label", "reasons", F.col("dataset").alias("test_dataset"),
                                  F.explode(F.coalesce(_cross_map(self.cross_pairs)[F.col("dataset")], F.array().cast("array<string>"))).alias("train_dataset"))
            .select(F.lit("cross").alias("setting"), "train_dataset", "test_dataset",
                    F.explode(F.array(*[F.lit(s) for s in self.seeds])).alias("seed"), "req_id",
                    F.concat_ws(":", "train_dataset", F.lit("all")).alias("tset"), "hit", "label", "reasons")
        )
        runs = intra_runs.unionByName(cross_runs)
        runs = runs.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in lexicon.VARIANT_NAMES])))
        runs = runs.withColumn("score_variant", F.when(F.col("hit"), F.col("variant")).otherwise(F.lit("original"))).drop("hit")
        return self._keep(runs, "runs")

    @property
    def score_rows(self) -> DataFrame:
        """Each (training set, row, distinct text) once, however many seeds and variants share it."""
        return self.runs.select("tset", "req_id", F.col("score_variant").alias("variant")).distinct()

    @property
    def score_flags(self) -> DataFrame:
        """(dataset, req_id, variant, use<k>): the sets of a training dataset that a text is scored with."""
        uses = [F.max(F.col("tset") == F.concat_ws(":", "train_dataset", F.lit(s))).alias(f"use{k}") for k, s in enumerate(self.sets.sets)]
        return self.runs.groupBy(F.col("train_dataset").alias("dataset"), "req_id", F.col("score_variant").alias("variant")).agg(*uses)

    @cached_property
    def vocab_sets(self) -> DataFrame:
        return self._keep(naive_bayes.vocabulary(self.rows, self.terms, self.sets), "vocab")

    @property
    def vocab(self) -> DataFrame:
        """(tset, term, df, n_docs, idf)."""
        return naive_bayes.long_vocabulary(self.vocab_sets, self.sets)

    def train_x(self, vocab: DataFrame | None = None, carry=()) -> DataFrame:
        """Weights of the training texts; with a ``vocab`` that has more columns, those of ``carry`` beside them."""
        return features.tfidf(self.train.select("tset", "req_id"), self.terms, self.vocab if vocab is None else vocab, carry=carry)

    def test_x(self, vocab: DataFrame | None = None, carry=()) -> DataFrame:
        return features.tfidf(self.score_rows, self.terms_v, self.vocab if vocab is None else vocab, ("req_id", "variant"), carry)

    def test_x_of(self, copies=lambda df: df):
        """A function of a table (tset, term): the rows of :meth:`test_x` for these terms, from norms that are made once.

        ``copies`` is applied to the weights; a name of ``wanted`` may carry what it adds after a ``#``.
        """
        keys = ("req_id", "variant")
        norms = self._keep(features.tfidf_norms(self.score_rows, self.terms_v, self.vocab, keys), "norms")
        own = F.split("tset", "#")[0].alias("tset")
        return lambda wanted: copies(features.tfidf_of(wanted.select(own, "term"), norms, self.terms_v, self.vocab, keys))

    def instances(self, predictions: DataFrame, model: str, with_text: bool = False) -> DataFrame:
        """T3 rows: runs joined with (tset, req_id, variant, y_pred).

        Runs already carry the label and reasons; the (original) text is joined
        back only when ``with_text`` asks for full instance rows.
        """
        preds = predictions.withColumnRenamed("variant", "score_variant")
        on = ["tset", "req_id", "score_variant"] + (["seed"] if "seed" in predictions.columns else [])
        r = self.runs.join(preds, on, "left")
        text = F.lit(None).cast("string")
        if with_text:
            r = r.join(self.req.select("req_id", "requirement_text"), "req_id")
            text = F.col("requirement_text")
        return r.select(
            "setting", "variant", "train_dataset", "test_dataset", F.lit(model).alias("model"),
            F.col("seed").cast("int").alias("seed"), "req_id", text.alias("text"),
            F.col("label").cast("int").alias("y_true"), F.col("y_pred").cast("int").alias("y_pred"), "reasons",
        )


def _nb_scores_distinct(data: ClassicalData) -> DataFrame:
    head = naive_bayes.frequent_terms(data.vocab_sets, data.sets)
    term_model, class_model = naive_bayes.fit(data.rows, data.terms, data.vocab_sets, data.sets, data.labels, head=head)
    return naive_bayes.class_scores(data.score_flags, data.terms_v, term_model, class_model, data.sets, data.labels, head=head)


def nb_scores(data: ClassicalData) -> DataFrame:
    """Class scores (tset, req_id, variant, label, score) for every (training set, row, variant)."""
    scores = _nb_scores_distinct(data).withColumnRenamed("variant", "score_variant")
    keys = data.runs.select("tset", "req_id", "variant", "score_variant").distinct()
    return keys.join(scores, ["tset", "req_id", "score_variant"]).select("tset", "req_id", "variant", "label", "score")


def nb_instances(data: ClassicalData, model: str = "MultinomialNB", with_text: bool = False) -> DataFrame:
    """I10-I12 for the naive Bayes model: prediction rows of the whole grid."""
    preds = naive_bayes.predict(_nb_scores_distinct(data), keys=("req_id", "variant"))
    return data.instances(preds, model, with_text)


def svm_decisions(data: ClassicalData, **options) -> tuple[DataFrame, linear_svm.SvmModel]:
    """Decision values (tset, req_id, variant) of every distinct text, and the model: one fit for all training sets."""
    train = linear_svm.term_weights(data.rows, data.terms, data.vocab_sets, data.sets)
    model = linear_svm.fit(data.rows, train, data.sets, **options)
    return linear_svm.text_decisions(data.score_flags, data.terms_v, data.vocab_sets, model, data.sets), model


def svm_instances(data: ClassicalData, model: str = "LinearSVM", with_text: bool = False, **options) -> DataFrame:
    """I10-I12 for the squared-hinge SVM: prediction rows of the whole grid; a decision of 0 is class 0."""
    scored, _ = svm_decisions(data, **options)
    preds = scored.select("tset", "req_id", "variant", (F.col("decision") > 0).cast("int").alias("y_pred"))
    return data.instances(preds, model, with_text)


def per_seed(data: ClassicalData):
    """Copies a table of training sets for every seed that a set serves: its own, or all of them (cross); the set's name gets the seed."""
    seeds = F.array(*[F.lit(int(s)) for s in data.seeds])
    own = F.split("tset", ":")[F.size(F.split("tset", ":")) - 1]
    fits = F.when(own == "all", seeds).otherwise(F.array(own.try_cast("int")))
    return lambda df: df.withColumn("seed", F.explode(fits)).withColumn("tset", F.concat_ws("#", "tset", "seed"))


def boosted_instances(data: ClassicalData, model: str, params: boosting.BoostParams | None = None, with_text: bool = False) -> DataFrame:
    """I8 + I10-I12 for a boosted-tree model of :data:`boosting.MODELS`: all sets of the grid in one run.

    The samples of a tree depend on the seed, so a set that serves several seeds (cross) is fitted for each.
    """
    many = per_seed(data)
    train = data.train.select("tset", "req_id", F.lit("original").alias("variant"), F.col("label").cast("double").alias("y"), F.lit(True).alias("train"))
    score = data.score_rows.select("tset", "req_id", "variant", F.lit(None).cast("double").alias("y"), F.lit(False).alias("train"))
    x = many(data.train_x().withColumn("variant", F.lit("original"))).drop("seed")
    rows, _ = boosting.boost(many(train.unionByName(score)), x, params or boosting.MODELS[model], ("req_id", "variant"), "seed",
                             data.test_x_of(lambda df: many(df).drop("seed")))
    preds = rows.where(~F.col("train")).select(
        F.split("tset", "#")[0].alias("tset"), "req_id", "variant", "seed", (F.col("margin") > 0).cast("int").alias("y_pred"))
    return data.instances(preds, model, with_text)
