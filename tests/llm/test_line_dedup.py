from collections import Counter, defaultdict

from cohortlake.llm import line_dedup as ld
from tests.oracle import connect, differences


def by_hand(rows, percent=30, least=5, wide=None):
    """Kept texts of (site, text) rows; ``wide`` is the percentage and the least number of different texts."""
    pages, total, texts = defaultdict(Counter), Counter(), defaultdict(set)
    for site, text in rows:
        lines = tuple(dict.fromkeys(x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")))
        total[site] += 1
        pages[site].update(lines)
        texts[site].add(lines)
    kinds = {site: Counter(x for lines in kept for x in lines) for site, kept in texts.items()}
    out = []
    for site, text in rows:
        drop = {x for x, n in pages[site].items() if n >= least and 100 * n > percent * total[site]}
        if wide is not None:
            drop |= {x for x, n in kinds[site].items() if n >= wide[1] and 100 * n > wide[0] * len(texts[site])}
        out.append(None if text is None else "\n".join(x for x in text.split("\n") if x not in drop))
    return out


def test_lines_of_many_different_texts_go(make_docs, edges):
    """Both rules against the plain ones: a line on a tenth of the different texts, copies counted once."""
    rows = [(i, f"own {i}\nshared by tenth\nx" if i % 10 == 0 else f"own {i}\nx {i % 30}", "en", "many") for i in range(400)]
    rows += [(1000 + i, "copied\ntwice", "en", "many") for i in range(60)] + [(2000 + i, f"few {i}\ntail", "en", "few") for i in range(15)] + edges
    out = ld.documents_without_boilerplate(make_docs(rows), wide_percent=5).collect()
    want = Counter((r[0], t) for r, t in zip(rows, by_hand([(r[3], r[1]) for r in rows], wide=(5, 20)), strict=True))
    assert Counter((r.doc_id, r.text) for r in out) == want
    assert not any("shared" in (r.text or "") for r in out)


def test_documents_lose_the_lines_of_their_source(make_docs, edges):
    rows = [(i, f"head\nbody {i}\n\nhead\nfoot {i % 3}", "en", "a" if i % 4 else None) for i in range(40)]
    rows += [(100 + i, "head\nonly here", "en", "few") for i in range(3)] + edges
    docs = make_docs(rows)
    out = ld.documents_without_boilerplate(docs)
    assert out.columns == docs.columns
    want = Counter((r[0], t) for r, t in zip(rows, by_hand([(r[3], r[1]) for r in rows]), strict=True))
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert any(r.text == f"body {r.doc_id}\n" for r in got if r.doc_id is not None)


def test_pages_lose_the_lines_of_their_host(spark):
    html = "<html><style>p{{}}</style><!-- a --><nav>Menu</nav><p>Text <b>{0}</b></p><script>x</script>\n Foot \n</html>"
    rows = [(i, "http://A.b/x", html.format(i)) for i in range(10)] + [(20, "http://c.d/", html.format(1)), (21, None, None), (22, "", "plain")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, _lines string")
    out = {r.page_id: r for r in ld.page_lines(df).collect()}
    assert list(out[3].lines) == ["Menu", "Text 3", "Foot"] and list(out[3].kept) == ["Text 3"]
    assert list(out[20].kept) == ["Menu", "Text 1", "Foot"]
    assert (out[21].host, list(out[21].lines), list(out[22].kept)) == ("", [], ["plain"])


def test_empty_tables(spark, make_docs):
    assert ld.documents_without_boilerplate(make_docs([]).limit(0)).count() == 0
    assert ld.page_lines(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_query_equals_sql(spark, sf_dir):
    from cohortlake.llm.registry import ORACLES

    assert differences(ld.op4_line_dedup(spark, sf_dir), connect(sf_dir), ORACLES["op4_line_dedup"]) == []
