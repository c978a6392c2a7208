"""Tree ensembles on encoded transactions."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .helpers import stratified_split

FEATURES = ["step", "type", "amount", "nameOrig", "oldBalOrg", "newBalOrg", "nameDest", "oldBalDest", "newBalDest", "isFlagged"]

MODELS = {
    "random_forest": lambda: RandomForestClassifier(impurity="gini", maxDepth=10, numTrees=10, featureSubsetStrategy="auto", seed=3000),
    "gbt": lambda: GBTClassifier(maxIter=10, maxDepth=10, seed=3000),
    "decision_tree": lambda: DecisionTreeClassifier(impurity="entropy", maxDepth=10, maxBins=30, seed=3000),
}


def prepared(encoded: DataFrame) -> DataFrame:
    """txn_id, features and label; the most frequent class is label 0."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(encoded)
    return StringIndexer(inputCol="isFraud", outputCol="label").fit(rows).transform(rows).select("txn_id", "features", "label")


def fitted(encoded: DataFrame, model: str):
    """The model fitted to all rows, its features by their place in FEATURES."""
    return MODELS[model]().fit(prepared(encoded))


def scored(encoded: DataFrame, models: list[str], share: float = 0.7, seed: int = 20) -> DataFrame:
    """model, auc and accuracy of each model, fitted to a stratified share of the rows, on the others.

    The encoded rows are read once and kept while the models are fitted and judged; a lost part is encoded again.
    """
    rows = prepared(encoded).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train, test = stratified_split(rows, "label", share, seed)
        out = []
        for name in models:
            judged = MODELS[name]().fit(train).transform(test)
            accuracy = judged.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
            out.append((name, BinaryClassificationEvaluator().evaluate(judged), accuracy))
        return encoded.sparkSession.createDataFrame(out, "model string, auc double, accuracy double")
    finally:
        rows.unpersist()
