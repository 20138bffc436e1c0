from lodestone import sources as S
from lodestone.sources.files import books_of


def test_files(spark, tmp_path):
    w = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    b = S.baskets_text(spark, w("b", "1 2 2  3\n\n7\n")).orderBy("basket_id").collect()
    assert [list(r["items"]) for r in b] == [[1, 2, 3], [], [7]]
    e = S.edges_text(spark, w("e", "# c\n1 2\n\n3\n4 x\n 5  6 9\n")).orderBy("seq").collect()
    assert [(r["u"], r["v"]) for r in e] == [(1, 2), (5, 6)]
    assert [tuple(r) for r in S.edges_csv(spark, w("c", "1,2\n2,3\n")).collect()] == [(1, 2), (2, 3)]
    g = S.graph_adjacency(spark, w("g", "% c\n3 2\n2 3\n# gap\n1\n\n")).orderBy("id").collect()
    assert [(r["id"], list(r["neighbours"])) for r in g] == [(1, [2, 3]), (3, [1]), (4, [])]
    p = S.graph_parts(spark, w("p", "1\n0\n2\n")).orderBy("id").collect()
    assert [tuple(r) for r in p] == [(1, 1), (2, 0), (3, 2)]


def test_books(spark, tmp_path):
    (tmp_path / "b.csv").write_text("bookno,Title,Author,Language\n1, T ,A,en\n2,U,B,en\n")
    (tmp_path / "s.csv").write_text('bookno,content\n1,"old"\n1,"line\none, ""two"""\n2,x\n')
    got = books_of(S.books_csv(spark, str(tmp_path / "b.csv")), S.stories_csv(spark, str(tmp_path / "s.csv")), "A").collect()
    assert [tuple(r) for r in got] == [("1", 'line\none, "two"')]


def test_documents_and_report(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for n in ("b.txt", "a.txt"):
        (tmp_path / "d" / n).write_text(f"text of {n}\n")
    assert [tuple(r) for r in S.documents_text(spark, str(tmp_path / "d")).orderBy("doc_id").collect()] == [(0, "a.txt", "text of a.txt\n"), (1, "b.txt", "text of b.txt\n")]
    r = spark.createDataFrame([(1, 5, 2, 1), (0, 9, 1, 1)], "round int, edge_cut long, swaps long, migrations long")
    S.round_report(r, str(tmp_path / "r"))
    assert "edge_cut" in next((tmp_path / "r").glob("part-*")).read_text()
