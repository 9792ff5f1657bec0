import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelake.functions import scalars, sqltext
from scorelake.functions.edges import labels, most_bins
from scorelake.operators import stats, woe
from scorelake.sources.tables import read_names, sheet_name, write_names

CASES = [
    ("SELECT 1 -- one\nFROM t", "SELECT 1 \nFROM t"),
    ("SELECT /* x */ 1", "SELECT  1"),
    ("SELECT /*+ BROADCAST(t) */ 1", "SELECT /*+ BROADCAST(t) */ 1"),
    ("SELECT '-- no', \"/* no */\"", "SELECT '-- no', \"/* no */\""),
    ("SELECT 'it''s -- x' -- y", "SELECT 'it''s -- x' "),
    ("a -- x\r\nb", "a \r\nb"),
    ("SELECT 1 /* open", "SELECT 1 /* open"),
    ("/* a /* b */ c */", " c */"),
    ("SELECT '' -- x", "SELECT '' "),
    ("", ""),
]


@pytest.mark.parametrize("sql,want", CASES)
def test_comments(sql, want):
    assert sqltext.remove_comments(sql) == want


def test_statements_and_fields():
    assert sqltext.split_statements("select ';' ; select 2;; -- a;b\nselect 3") == ["select ';'", "select 2", "-- a;b\nselect 3"]
    assert sqltext.split_fields("a, f(b, c), 'x,y', case when d then e end") == ["a", "f(b, c)", "'x,y'", "case when d then e end"]
    assert sqltext.format_select("select a, f(b, c) from t where x") == "select\n    a\n  , f(b, c)\nfrom t where x"
    assert sqltext.load_sql(query="select {c} -- x\n from {t}; select 2", split=True, c="a", t="b") == ["select a \n from b", "select 2"]
    assert sqltext.fill_template("{a} {b}", a=1) == ("1 {b}", ["b"])
    assert sqltext.select_list(["a", "b", "c"], ("b",), "t", True) == "t.`a`, t.`c`"
    assert [(n, w) for n, w, _ in sqltext.dialect_issues("select collect_list(x)\nfrom t -- rlike\nlateral view explode(y) z")] == [(1, "collect_list("), (3, "lateral view")]


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(min_codepoint=32, max_codepoint=126), max_size=40), st.text(min_size=1, max_size=8))
def test_cipher(text, key):
    assert scalars.xor_decrypt(scalars.xor_encrypt(text, key), key) == text
    with pytest.raises(ValueError):
        scalars.xor_decrypt("!", key)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50)), min_size=1, max_size=15))
def test_merges(counts):
    sizes = woe.monotone_merge(counts)
    assert sum(sizes) == len(counts)
    bads, goods = (sum(c[i] for c in counts) for i in (0, 1))
    assert woe.is_monotone([round(woe.smoothed(b, g, bads, goods)[0], 9) for b, g in woe._pool(counts, sizes)])
    sizes = woe.chi_merge(counts, 4)
    assert sum(sizes) == len(counts) and len(sizes) <= 4


def test_small_rules():
    assert most_bins(50, 1000) in (19, 20) and most_bins(10, 0) == 10
    assert labels([-math.inf, 1.0, math.inf]) == {0: "missing", 1: "(-inf, 1]", 2: "(1, inf]"}
    assert woe.chi_square_p(3.841458820694124) == pytest.approx(0.05, abs=1e-9)
    assert woe.tree_edges([(v, 10.0 * (v > 3), 10.0 * (v <= 3)) for v in range(8)], 2)[1] == 3.5
    assert woe.cluster_categories([("a", 1, 99), ("b", 1, 98), ("c", 60, 40)], 2) == [["a", "b"], ["c"]]
    assert woe.direction([1, 2, 3]) == "up" and woe.direction([1, 3, 2]) == "none"
    assert stats.correlation_filter([("a", "b", 0.9), ("b", "c", 0.1)], {"a": 0.2, "b": 0.3, "c": 0.1}, 0.75) == ["b", "c"]
    assert scalars.valid_vintages(202311, 202402) == [202311, 202312, 202401, 202402]
    assert scalars.hex_to_rgb("#ff8000") == (255, 128, 0) and scalars.title_case("a_bc") == "A Bc"
    assert sheet_name("a/b" * 20, {("a_b" * 20)[:31]}).endswith("_2")


def test_name_files(tmp_path):
    path = str(tmp_path / "names")
    write_names(["a", "b"], path, quote="none")
    assert read_names(path) == ["A", "B"]


def test_woe_json():
    model = woe.WoeModel([woe.FeatureBins("x", [-math.inf, 1.0, math.inf], [], [0.1, -0.1], 0.5)])
    assert woe.WoeModel.from_json(model.to_json()) == model
    assert np.isinf(model.features[0].edges[0])
