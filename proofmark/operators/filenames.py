"""Matching application files with label images by their names.

The nested comparison becomes equality joins on the telling words of the names. A match needs a
shared word; one shared word outweighs everything else, so only images that share the most words
can win or tie. They are found from the rarest words on: an image that shares all but t of an
application's words has one of its t + 1 rarest, so common words are joined only for the few names
that nothing rarer matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmark.functions import text
from proofmark.functions.fuzzy import sequence_ratio
from proofmark.runtime import checkpointed


def best_images(applications: DataFrame, images: DataFrame) -> DataFrame:
    """(app_name, image_name): the image of greatest score (ten per shared word plus the ratio of
    the stems); blank where no word is shared or the two best tie. Image names given twice tie.
    Null names count as blank."""
    named = applications.select(F.coalesce("file_name", F.lit("")).alias("app_name")).distinct()
    imgs = checkpointed(images.where(F.col("file_name").isNotNull()).select(F.col("file_name").alias("image_name")).groupBy("image_name").agg(F.count("*").alias("times")).withColumn("words", text.file_tokens(F.col("image_name"))))
    posting = imgs.select("image_name", "times", "words", F.explode("words").alias("w"))
    seen = posting.groupBy("w").agg(F.count("*").alias("n"))
    # An application's words that any image has, rarest first.
    ranked = named.select("app_name", F.explode(text.file_tokens(F.col("app_name"))).alias("w")).join(seen, "w").groupBy("app_name").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("r"))
    waiting = checkpointed(ranked.select("app_name", F.transform("r", lambda x: x["w"]).alias("own")))
    won: list[DataFrame] = []
    lacking = 0
    while not waiting.isEmpty():
        probe = waiting.select("app_name", "own", F.explode(F.slice("own", 1, lacking + 1)).alias("w"))
        pairs = probe.join(posting, "w").select("app_name", "own", "image_name", "times", F.size(F.array_intersect("own", "words")).alias("shared"))
        pairs = pairs.where(F.col("shared") == F.greatest(F.lit(1), F.size("own") - lacking)).select("app_name", "image_name", "times").distinct()
        score = sequence_ratio(text.file_stem(F.col("app_name")), text.file_stem(F.col("image_name")))
        scored = pairs.withColumn("score", score).groupBy("app_name", "score").agg(F.sum("times").alias("times"), F.min("image_name").alias("image_name"))
        best = checkpointed(scored.groupBy("app_name").agg(F.max(F.struct("score", "times", "image_name")).alias("b")).select("app_name", "b.times", "b.image_name"))
        won.append(best)
        waiting = checkpointed(waiting.join(best.select("app_name"), "app_name", "left_anti").where(F.size("own") > lacking + 1))
        lacking += 1
    if not won:
        return named.select("app_name", F.lit("").alias("image_name"))
    found = reduce(DataFrame.unionByName, won)
    return named.join(found, "app_name", "left").select("app_name", F.when(F.col("times") == 1, F.col("image_name")).otherwise("").alias("image_name"))
