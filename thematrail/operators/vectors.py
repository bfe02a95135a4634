"""Lexical page vectors for use where no embedding model is at hand."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame



def tfidf_model(pages: DataFrame, n_features: int = 1024) -> PipelineModel:
    """Hashed TF-IDF with unit length, fitted on the page texts in one pass."""
    stages = [
        RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+", toLowercase=True),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=n_features),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit", p=2.0),
    ]
    return Pipeline(stages=stages).fit(pages.select("text"))


def tfidf_vectors(model: PipelineModel, texts: DataFrame) -> DataFrame:
    """``texts`` with an ``embedding``; use one model for pages and questions."""
    vectors = model.transform(texts).withColumn("embedding", vector_to_array("_unit", "float32"))
    return vectors.drop("_words", "_tf", "_tfidf", "_unit")
