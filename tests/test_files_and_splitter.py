import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arbor.operators import maintenance as M
from arbor.operators.splitter import split_documents, split_text, tokens
from arbor.sources import files


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="ab .!?\n\té", max_size=400), st.integers(1, 12))
def test_pieces_join_to_the_text_and_fit(text, most):
    pieces = split_text(text, most)
    assert "".join(pieces) == text
    assert all(p and tokens(len(p)) <= most for p in pieces)


def test_pieces_begin_after_the_coarsest_separator():
    assert split_text("aaaa bbbb. cccc dddd.\n\neeee ffff.", 6) == ["aaaa bbbb. cccc dddd.\n\n", "eeee ffff."]


def test_split_documents_of_null_blank_and_long_texts(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, " \n ", 0), (4, "word " * 100, 0)], "doc_id long, text string, span_start int")
    rows = sorted(split_documents(docs, 10).collect())
    assert {r.document_id for r in rows} == {4}
    assert "".join(r.text for r in rows) == "word " * 100
    assert all(r.span_end - r.span_start == len(r.text) for r in rows)


def test_jsonl_leaves_out_broken_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n[1]\n{"k": \n"x"\n{"k": 2, "z": 0}\n')
    assert sorted(r.k for r in files.read_jsonl(spark, str(tmp_path), "k long").collect()) == [1, 2]


def test_texts_and_journal(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one\ntwo\n")
    assert [r.text for r in files.read_texts(spark, str(tmp_path / "t")).collect()] == ["one\ntwo\n"]
    for k in (1, 2):
        files.append_journal(spark.createDataFrame([(k,)], "k long"), str(tmp_path / "j"))
    assert sorted(r.k for r in files.read_jsonl(spark, str(tmp_path / "j"), "k long").collect()) == [1, 2]


def test_versions(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        files.read_version(spark, path)
    for n in (3, 2):
        files.write_version(spark.range(n), path)
        assert files.read_version(spark, path).count() == n


def test_repair_reaches_a_bounded_number_of_hops(spark):
    rows = [(1, k, 5.0 if k == 0 else 0.0, 6.0 if k == 0 else None) for k in range(5)]
    u = spark.createDataFrame(rows, "document_id long, level_index long, time_start double, time_end double")
    got = {r.level_index: r.time_start for r in M.repair_times(u, hops=2).collect()}
    assert got == {0: 5.0, 1: 6.0, 2: 6.0, 3: None, 4: None}


def test_truncation_by_time_keeps_units_without_a_time_and_closes_gaps(spark):
    rows = [(1, 0, 0, 10, 1.0), (1, 1, 10, 14, 9.0), (1, 2, 14, 20, None)]
    u = spark.createDataFrame(rows, "document_id long, level_index long, span_start long, span_end long, time_end double")
    assert sorted((r.level_index, r.span_start, r.span_end) for r in M.truncate_by_time(u, 5.0).collect()) == [(0, 0, 10), (2, 10, 16)]


def test_pieces_of_a_batch_are_given_out_in_slices():
    import pandas as pd

    from arbor.operators.splitter import PIECES_CHARS, _pieces

    texts = ["word " * 60_000, None, ""] * 8
    got = list(_pieces(100)([pd.DataFrame({"document_id": range(len(texts)), "text": texts})]))
    assert len(got) >= 2 and max(g["text"].str.len().sum() for g in got) <= PIECES_CHARS + 300_000
    whole = pd.concat(got).groupby("document_id")["text"].agg("".join)
    assert whole.to_dict() == {i: t for i, t in enumerate(texts) if t}
