from pyspark.sql import functions as F

from folio.functions import text as X
from folio.functions.html import html_text
from folio.functions.vectors import cosine, from_bytes, to_bytes


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_paths(spark):
    names = ["doc.md", "a/b.markdown", "/x/page.HTML", "p.htm", "n.txt", "q.pdf", "z.xyz", ".md", "/a.b/none"]
    got = values(spark, [(n,) for n in names], "p string", X.mime_type(F.col("p")), X.extension(F.col("p")), X.title(F.col("p")), X.directory(F.col("p")))
    assert [g[0] for g in got] == ["text/markdown", "text/markdown", "text/html", "text/html", "text/plain", "application/pdf", X.OTHER_MIME, "text/markdown", X.OTHER_MIME]
    assert got[7][1:] == (".md", "", ".") and got[8][1:] == ("", "none", "/a.b")
    messy = ["./a/../b//c/", "/x/./y/../../z", "..", ""]
    assert [g[0] for g in values(spark, [(n,) for n in messy], "p string", X.normalize_path(F.col("p"), "/home/me"))] == ["/home/me/b/c", "/z", "/home", "/home/me"]


def test_markdown_and_html(spark):
    text = "---\ntitle: x\n---\n# Head\n\n**bold** _it_ `code` a_b_c\n```go\nfunc main() {}\n```\n"
    assert values(spark, [(text,)], "t string", X.markdown_text(F.col("t"))) == [("Head\n\nbold it code abc\nfunc main() {}",)]
    pages = ["<h1>Hello</h1><p>World</p>", "<p>Hello &amp; World &lt;3&gt;</p>", "<!-- c --><script>var t='</p>'</script> x ", None]
    assert [g[0] for g in values(spark, [(p,) for p in pages], "t string", html_text(F.col("t")))] == ["HelloWorld", "Hello & World <3>", "var t='</p>' x", None]


def test_html_bare_references(spark):
    pages = ["<title>a &amp</title><p>b &ampx &lt;3&gt; &copy;&notit; &#65; &#66 & &;</p>", "<b>\ue000 &amp</b>&amp;"]
    assert [g[0] for g in values(spark, [(p,) for p in pages], "t string", html_text(F.col("t"), bare=False))] == ["a &ampb &ampx <3> ©&notit; A &#66 & &;", "\ue000 &amp&"]
    assert values(spark, [("x &amp</p>",)], "t string", html_text(F.col("t"))) == [("x &",)]


def test_scalars(spark):
    got = values(spark, [("äöü" * 50,)], "t string", X.count_tokens(F.col("t")), X.preview(F.col("t"), 5), X.strip_control(F.lit("a\x07b\x1bc\x85\n\td\x7f")), X.strip(F.lit("　\x85 x\x1c ")))
    assert got == [(75, "äöüäö...", "abc\n\td", "x\x1c")]
    sizes = values(spark, [(0,), (1023,), (1024,), (1536,), (1 << 20,), (416000,)], "n long", X.human_bytes(F.col("n")))
    assert [s[0] for s in sizes] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 MB", "406.2 KB"]
    assert values(spark, [(0, 0), (1, 3), (3, 3)], "a long, b long", X.percent(F.col("a"), F.col("b"))) == [("0%",), ("33%",), ("100%",)]
    assert X.parse_pair("a=b=c") == ("a", "b=c") and X.parse_pair("=v") == ("", "v")
    for bad, strict in (("novalue", True), ("=v", False)):
        try:
            X.parse_pair(bad, strict)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_vectors(spark):
    rows = [([1.0, 0.5],), ([],), (None,)]
    got = values(spark, rows, "v array<float>", from_bytes(to_bytes(F.col("v"))), F.hex(to_bytes(F.col("v"))))
    assert got == [([1.0, 0.5], "0000803F0000003F"), ([], ""), (None, None)]
    assert values(spark, [(bytearray(b"abc"),)], "b binary", from_bytes(F.col("b"))) == [(None,)]
    pairs = [([1.0, 0.0], [0.6, 0.8]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([], [])]
    assert [round(g[0], 6) for g in values(spark, pairs, "a array<float>, b array<float>", cosine(F.col("a"), F.col("b")))] == [0.6, 0.0, 0.0, 0.0]
