"""The digest of chat formatting reads the trained texts under the loss mask."""

import hashlib

from pyspark.sql import functions as F

from scribegauge.llm import chat_format

TURNS = [(1, 0, "user", "hi"), (1, 1, "assistant", "a<|b\\|>é😀"), (1, 2, "assistant", "</s>[INST]"), (1, 3, "user", "x"), (1, 4, "assistant", "")]


def test_digest_follows_the_mask(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    made = chat_format.format_chat(turns)
    row = chat_format.chat_digest(made).first()
    told = "".join(t for _, _, role, t in TURNS if role == "assistant")
    assert (row["loss_chars"], row["loss_sha256"]) == (len(told), hashlib.sha256(told.encode()).hexdigest())
    # A mask that misses all of it, or ends one character early, is noticed.
    blank = made.withColumn("loss_runs", F.array(F.char_length("formatted"), F.lit(0)))
    assert chat_format.chat_digest(blank).first()["loss_chars"] == 0
    short = made.withColumn("loss_runs", F.transform("loss_runs", lambda n, i: F.when((i % 2 == 1) & (n > 0), n - 1).otherwise(n)))
    assert chat_format.chat_digest(short).first()["loss_sha256"] != row["loss_sha256"]
