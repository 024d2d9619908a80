"""Values worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattika.functions import arrays as A
from lattika.functions import graders as G
from lattika.functions import hooks
from lattika.operators import curation as C
from lattika.operators import kg as K
from lattika.operators import retrieval as R
from lattika.operators import rollout as O
from lattika.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def arr(*values):
    return F.array(*map(F.lit, values))


def test_backward(spark):
    assert one(spark, A.backward(arr(1.0, 2.0, 3.0), 0.9)) == pytest.approx([5.23, 4.7, 3.0])
    assert one(spark, A.backward(F.array().cast("array<double>"), 0.9)) == []


def test_advantages_match_a_loop(spark):
    rng = np.random.default_rng(0)
    r, v = rng.normal(size=(2, 64))
    want, run = np.zeros(64), 0.0
    for t in reversed(range(64)):
        run = r[t] + 0.99 * (v[t + 1] if t < 63 else 0) - v[t] + 0.99 * 0.95 * run
        want[t] = run
    got = one(spark, A.advantages(arr(*map(float, r)), arr(*map(float, v)), 0.99, 0.95))
    assert np.abs(np.array(got) - want).max() < 1e-5


def test_pass_at(spark):
    assert one(spark, O.pass_at(F.lit(4), F.lit(2), 2)) == pytest.approx(5 / 6)
    assert one(spark, O.pass_at(F.lit(4), F.lit(0), 4)) == 0
    assert one(spark, O.pass_at(F.lit(4), F.lit(3), 2)) == 1


def test_answers(spark):
    assert one(spark, G.relaxed_match(F.lit("The Alpha"), arr("alpha"))) == 1
    assert one(spark, G.normalize_answer(F.lit("An apple a day"))) == "apple day"
    assert one(spark, G.set_f1(arr("a1", "b1"), arr("b1", "c1"))) == pytest.approx(0.5)
    assert one(spark, G.parse_prediction(F.lit('["x", 0, "", null, " y "]'))) == ["x", "y"]
    assert one(spark, G.parse_prediction(F.lit("a | b |"))) == ["a", "b"]
    assert one(spark, G.parse_prediction(F.lit(None).cast("string"))) == []
    assert one(spark, G.relaxed_match(F.lit(None).cast("string"), arr("x"))) == 0


def test_boxed():
    assert G.last_boxed("\\boxed{1} \\boxed{\\frac{1}{2}}") == "\\frac{1}{2}"
    assert G.last_boxed("\\boxed{open") is None and G.last_boxed(None) is None


def test_paths(spark):
    path = arr("A", "r1", "B", "r2", "C", "r3", "D")
    assert one(spark, C.hops(path)) == 3
    assert one(spark, C.path_reason(path, require=2)) == "hops_not_equal"
    assert one(spark, C.path_reason(arr("A", "r", " a"))) == "duplicate_entities"
    assert one(spark, C.path_reason(path)) is None
    assert one(spark, C.split_path(F.lit("a -> b --> c → d"))) == ["a", "b", "c", "d"]


def test_flat_names(spark):
    assert one(spark, K.flat_name(F.lit("x.y.z"), F.lit("x.y.w"))) == "z.x.y.w"
    assert one(spark, K.flat_name(F.lit("a.b"), F.lit("c.d"))) == "a.b.c.d"


def test_whitelist_falls_back(spark):
    rows = spark.createDataFrame([("q1", "a"), ("q1", "b"), ("q2", "c")], "q string, relation string")
    assert sorted(map(tuple, K.keep_listed(rows, ["q"], ["a"]).collect())) == [("q1", "a"), ("q2", "c")]


def test_bins():
    assert O.first_fit([5, 4, 3, 2], 7) == [0, 1, 1, 0]
    assert O.chunk_by_size([3, 3, 3], 6) == [0, 1, 2]
    lengths = [8, 7, 6, 5, 4]
    parts = O.balance(lengths, 2)
    assert sorted(sum(x for x, p in zip(lengths, parts, strict=True) if p == k) for k in (0, 1)) == [14, 16]
    equal = O.balance([1, 2, 3, 4, 5, 6], 3, equal=True)
    assert sorted(equal) == [0, 0, 1, 1, 2, 2]
    with pytest.raises(ValueError):
        O.balance([1], 2)


def test_weights_are_normalised(spark):
    rows = spark.createDataFrame([([0.1, 0.2], [0.0, 0.0], [1, 1]), ([0.5, 9.0], [0.0, 0.0], [1, 0])], "a array<double>, b array<double>, m array<int>")
    out = A.importance_weights(rows, "a", "b", "m", normalize=True).collect()
    assert sum(w for r in out for w, m in zip(r.weights, r.m, strict=True) if m) == pytest.approx(3.0)


def test_whitening_needs_a_mask(spark):
    rows = spark.createDataFrame([([1.0], [0])], "v array<double>, m array<int>")
    with pytest.raises(Exception, match="mask is empty"):
        A.whiten(rows, "v", "m").collect()


def test_skip_list_is_a_bag(spark):
    rows = spark.createDataFrame([(1,), (1,), (1,), (2,)], "k int")
    done = spark.createDataFrame([(1,), (1,), (3,)], "k int")
    assert sorted(r.k for r in O.skip_finished(rows, done, "k").collect()) == [1, 2]


def test_prefixes(spark):
    texts = spark.createDataFrame([(1, "abcd"), (2, "x")], "text_id int, text string")
    keys = spark.createDataFrame([("ab",), ("abc",), ("zz",)], "key string")
    assert sorted(map(tuple, R.longest_prefix(texts, keys).collect())) == [(1, "abc", 3), (2, None, None)]


def test_hooks():
    assert hooks.load("math.sqrt")(9) == 3
    got = hooks.resolve_settings([{"name": "a", "path": "p", "top_k": 3}], {"top_k": 5, "top_p": 0.5}, {"top_p": 1, "n": 2})
    assert (got[0]["top_k"], got[0]["top_p"], got[0]["n"]) == (3, 0.5, 2)
    assert hooks.due(9, 10) and not hooks.due(8, 10) and hooks.due(4, 10, 5) and not hooks.due(1, None)
    with pytest.raises(ValueError):
        hooks.check_batch(4, 2, 3, 2)


def test_slices(spark, tmp_path):
    assert readers.parse_slice("a.jsonl@[2:5]") == ("a.jsonl", 2, 5)
    with pytest.raises(ValueError):
        readers.parse_slice("a.jsonl@[-1:2]")
    with pytest.raises(ValueError):
        readers.read_records(spark, "a.csv")
    (tmp_path / "x.jsonl").write_text('{"i": 1}\n{"i": 2}\nbroken\n{"i": 3}\n')
    rows = readers.read_records(spark, f"{tmp_path}/x.jsonl@[1:3]", "i int", ["i"])
    assert [r.i for r in rows.filter("i is not null").collect()] in ([2, 3], [1, 2])
    (tmp_path / "y.json").write_text('[{"i": 1}, {"i": 2}]')
    assert readers.read_json(spark, f"{tmp_path}/y.json", "i int").count() == 2


def test_unpack_inverts_pack(spark):
    rows = spark.createDataFrame([("a", 1, [1, 2]), ("a", 2, [3]), ("b", 1, [4, 5])], "k string, o int, t array<int>")
    packed = O.pack(rows, "k", "o", "t")
    assert {r.k: r.offsets for r in packed.collect()} == {"a": [0, 2, 3], "b": [0, 2]}
    assert sorted((r.k, r.place, r.tokens) for r in O.unpack(packed, "k").collect()) == [("a", 0, [1, 2]), ("a", 1, [3]), ("b", 0, [4, 5])]
