import json

import numpy as np
from pyspark.sql import functions as F

from lotloom.operators import descriptors, queue
from lotloom.sources import words


def test_words_of_arrays(spark):
    found = {"rec_texts": [" un ", "", "deux", "trois", "x", "y", "long"], "rec_scores": [0.9, 0.8, "?", 87.0, 0.5, -1], "rec_boxes": [[0, 0, 10, 5], [0, 0, 1, 1], [0, 0, 9, 9], [30, 2, 20, 12], [5, 5, 5, 9], [1.5, 2.5, 4, 6]]}
    df = spark.createDataFrame([("bare", json.dumps(found)), ("res", json.dumps({"res": found})), ("none", "{}"), ("bad", "{"), ("null", None)], "page string, body string")
    got = {}
    for r in words.words_of_arrays(df, "page", words.payload(F.col("body")), F.lit(2.0), F.lit(1.0)).collect():
        got.setdefault(r.page, []).append(tuple(r)[1:])
    want = [(0, "un", 0.9, 0, 0, 20, 5), (1, "trois", 0.87, 40, 2, 20, 10), (2, "y", 0.0, 4, 2, 4, 4)]
    assert sorted(got["bare"]) == sorted(got["res"]) == want and set(got) == {"bare", "res"}


def test_keypoints(spark, tmp_path):
    rng = np.random.default_rng(0)
    points = np.array([[1, 2, 0.2, 3, 4, 1.6, -1.0], [5, 6, 7, 8, 9, 0, 2]], np.float32)
    bits = rng.integers(0, 256, (2, 32)).astype(np.uint8)
    np.savez(tmp_path / "t.npz", keypoints=points, descriptors=bits)
    a, b = words.read_keypoints(spark, f"file://{tmp_path}").orderBy("kp_idx").collect()
    assert (a.size, a.octave, a.class_id, b.size) == (1.0, 2, -1, 7.0) and len(a.descriptor) == 8
    df = spark.createDataFrame([(a.descriptor, b.descriptor)], "a array<long>, b array<long>")
    assert df.select(descriptors.hamming(F.col("a"), F.col("b")).alias("d")).first().d == int(np.unpackbits(bits[0] ^ bits[1]).sum())


def test_queue(spark):
    lots = spark.createDataFrame([("VN LOT 10", 10, "ready"), ("VN LOT 2", 2, "ready"), ("VN LOT 3", 3, "incomplete"), ("VN LOT 4", 4, "ready")], "name string, lot_number long, status string")
    chosen = spark.createDataFrame([("VN LOT 10", "t"), ("VN LOT 2", "t"), ("VN LOT 2", "t"), ("VN LOT 3", "t"), ("VN LOT 4", "")], "name string, template_id string")
    assert [r.name for r in queue.queue(lots, chosen).collect()] == ["VN LOT 2", "VN LOT 10"]
    df = spark.createDataFrame([(None, False, False, 0.1), ("incomplete", False, False, 0.1), ("ready", True, False, 0.1), ("ready", True, True, 2.0), ("ready", True, True, 0.1), ("ready", None, None, None)], "s string, o boolean, c boolean, t double")
    said = [r.g for r in df.select(queue.gate(*[F.col(c) for c in "soct"]).alias("g")).collect()]
    assert [None if s is None else s.split()[1] for s in said] == ["not", "is", "already", "must", None, "must"]
    results = spark.createDataFrame([("success", True), ("error", False), ("success", None)], "status string, had_outputs boolean")
    assert tuple(queue.queue_counts(results).first()) == (2, 1, 1)
