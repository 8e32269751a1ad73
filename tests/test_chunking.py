import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.operators.chunking import chunk_documents, spans, validate


def texts(text, size, overlap):
    data = text.encode()
    return [data[a:b].decode() for a, b in spans(data, size, overlap)]


def test_cases():
    assert texts("Short text.", 800, 100) == ["Short text."]
    assert texts("whole text", 0, 0) == ["whole text"] == texts("whole text", -5, 0)
    three = "".join(c * 1596 + ". " for c in "abc")
    parts = texts(three, 400, 100)
    assert parts[0].endswith("a. ") and len(parts) > 2 and parts[-1].endswith("c. ")
    assert [len(x) for x in texts("x" * 4000, 800, 100)][0] == 3200
    first, second = texts("Hello! " + "This is a normal sentence. " * 300, 800, 100)[:2]
    assert first.endswith(". ") and second[:20] in first
    for text, size, overlap in (("文字文字文字" * 60, 10, 2), ("é" * 30 + ". " + "ü" * 200, 20, 5)):
        for part in texts(text, size, overlap):
            assert part and part in text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?\n文é", min_size=1, max_size=200), st.integers(1, 12), st.integers(0, 11))
def test_chunks_cover_the_text(text, size, overlap):
    data, found = text.encode(), spans(text.encode(), size, min(overlap, size - 1))
    assert found[0][0] == 0 and found[-1][1] == len(data)
    for (a, b), (c, d) in zip(found, found[1:]):
        assert a < c <= b <= d
        assert b - a <= 4 * size
    for a, b in found:
        data[a:b].decode()


def test_rows(spark):
    rows = chunk_documents(spark.createDataFrame([(7, "one. two. three. " * 10), (8, ""), (9, " \n\t　"), (10, None)], "document_id long, text string"), 10, 2).collect()
    assert {r["document_id"] for r in rows} == {7}
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert all(r["token_count"] == len(r["text"].encode()) // 4 for r in rows) and len({r["chunk_id"] for r in rows}) == len(rows)
    wide = chunk_documents(spark.createDataFrame([((1 << 63) - 1, "x"), (-(1 << 63), "x")], "document_id long, text string"))
    assert len({r["chunk_id"] for r in wide.collect()}) == 2  # ids of the whole range


@pytest.mark.parametrize(("size", "overlap"), [(0, 0), (10, 10), (10, -1)])
def test_sizes_are_checked(size, overlap):
    with pytest.raises(ValueError):
        validate(size, overlap)
