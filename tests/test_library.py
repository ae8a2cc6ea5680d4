"""The library as a whole, remote paging, streams and pages."""

import json

import pytest
from pyspark.sql import functions as F

from quillstone.library import PAPERS, ROWS, SEARCHES, Library, LibraryError, Settings, attach_pdf, stated
from quillstone.operators import render
from quillstone.operators import retrieval as R
from quillstone.operators import search as S
from quillstone.sources import files
from quillstone.sources.remote import Client, RemoteError, SearchSource, full_text
from quillstone.streaming.ingest import ingest_files, searches_by_hour


def rows_of(spark, key, texts, first=0):
    kinds = ["abstract"] + ["text"] * (len(texts) - 1)
    return spark.createDataFrame([(f"{key}::{k}::{max(0, i - 1)}", key, key, f"Paper {key}", k, t, "Intro", i, ["x"], first + i) for i, (k, t) in enumerate(zip(kinds, texts, strict=True))],
                                 "id string, doc_key string, pmid string, title string, type string, text string, section string, page int, tags array<string>, seq long")


@pytest.fixture
def library(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/home")
    with pytest.warns(UserWarning):
        assert lib.ask("anything").count() == 0
    assert lib.ingest(rows_of(spark, "1", ["zinc heals wounds by 42.5 percent", "copper wires", "iron gates"]).unionByName(rows_of(spark, "2", ["zinc mines", "silver spoon", "gold ring"], 10))) == {"rows": 6, "papers": 2}
    return lib


def test_questions_and_mutations(spark, library):
    assert library.lexical("silver spoon", 1).first()["id"] == "2::text::0"
    assert [r["lex_rank"] for r in library.lexical("", 3).collect()] == [1, 2, 3]
    assert {r["doc_key"] for r in library.ask("zinc", pmid="2").collect()} == {"2"}
    assert library.ingest(rows_of(spark, "1", ["again"])) == {"rows": 0, "papers": 0}
    claim = {"text": "Zinc heals, 42.5 percent", "source_chunk_ids": ["1::abstract::0"], "evidence_span": "zinc HEALS wounds", "direction": "increase"}
    assert library.add_claims("1", [claim, claim]) == 2 and library.add_claims("1", [claim]) == 1
    got = library.ask("zinc heals wounds", k=3, claims_k=1).collect()
    assert [r["id"] for r in got if r["part"] == 0] == ["1::claim::0"] and "1::abstract::0" not in [r["id"] for r in got]
    assert {r["type"] for r in library.ask("zinc", strategy="claims").collect()} == {"claim"}
    for bad, code in (({"evidence_span": "lead"}, "evidence_span_not_in_source"), ({"direction": "up"}, "invalid_direction"), ({"source_chunk_ids": ["9"]}, "unknown_source_chunk_ids"), ({"text": "99 percent"}, "numbers_not_in_source")):
        with pytest.raises(LibraryError) as e:
            library.add_claims("1", [claim | bad])
        assert e.value.payload["error"] == code
    library.tag(["2"], add=["y", "x"], remove=["q"])
    assert {tuple(r["tags"]) for r in library.rows().where("doc_key = '2'").collect()} == {("x", "y")}
    library.ingest(rows_of(spark, "1", ["new only"]), force=True)
    assert [r["id"] for r in library.rows().where("doc_key = '1'").collect()] == ["1::abstract::0"]
    assert library.add_members("p", ["1", "2", "1"], "search") == ["1", "2"] and library.add_members("p", ["2"], "manual") == []
    assert {r["doc_key"]: r["via"] for r in library.members().collect()} == {"1": ["search"], "2": ["search", "manual"]}
    assert library.project_rows("p").count() == 4
    assert library.remove(["2", "8"]) == {"removed": ["2"], "not_found": ["8"]}
    assert library.sync("p") == {"pruned": ["2"], "no_chunks": ["1"]} and library.sync("p")["pruned"] == []
    with pytest.raises(LibraryError):
        library.add_members("p", ["77"], "x")


def test_a_change_writes_the_parts_that_it_touches(spark, library):
    before = library.store.manifest()["tables"]["rows"]
    assert library.add_claims("1", [{"text": "Zinc heals wounds", "source_chunk_ids": ["1::abstract::0"], "evidence_span": "zinc heals"}]) == 1
    tables = library.store.manifest()["tables"]
    changed = [p for p, change in tables["rows"].items() if before.get(p) != change]
    assert len(changed) == 1 and library.rows([int(changed[0])]).select("doc_key").distinct().collect()[0][0] == "1"
    library.tag(["2"], add=["t"])
    assert library.store.manifest()["tables"]["blocks"] == tables["blocks"]
    # the parts' postings and numbers are those of the whole
    index, rows = library.index(), library.rows()
    assert sorted(index.postings.select("id", "term", "tf", "dl").collect()) == sorted(R.postings(rows).collect())
    stats = R.corpus_stats(rows).first()
    assert (index.n, index.avgdl) == (stats["n"], stats["avgdl"])
    want = {r["term"]: round(r["idf"], 9) for r in R.term_stats(R.postings(rows), R.corpus_stats(rows)).collect()}
    assert {r["term"]: round(r["idf"], 9) for r in index.idf().collect()} == want


def test_missing_indexes_and_models(spark, tmp_path):
    vectors = {"zinc": [1.0, 0.0], "gold": [0.0, 1.0]}
    asked = []
    lib = Library(spark, f"file://{tmp_path}/h", embed=lambda q: asked.append(q) or vectors["gold"])
    with pytest.warns(UserWarning, match="no model"):
        assert lib.ask("gold").count() == 0
    lib.ingest(rows_of(spark, "1", ["zinc", "gold", "iron"]))
    lib.tables.write("vectors", spark.createDataFrame([("1::abstract::0", vectors["zinc"]), ("1::text::0", vectors["gold"])], "id string, v array<float>"))
    assert lib.ask("gold", strategy="chunks", k=1).first()["id"] == "1::text::0" and asked[-1].startswith("Represent this sentence")
    lib.drop_index()
    with pytest.warns(UserWarning, match="dense hits only"):
        assert [r["id"] for r in lib.ask("zinc", strategy="chunks", k=1).collect()] == ["1::text::0"]
    lib.reindex()
    assert lib.lexical("zinc", 1).first()["id"] == "1::abstract::0"
    other = Library(spark, f"file://{tmp_path}/h", model="other/model")
    with pytest.warns(UserWarning, match="bge-small"):
        assert other.ask("gold").count() == 0


def test_evaluation_of_real_strategies(spark, library):
    library.add_claims("1", [{"text": "Zinc heals, 42.5 percent", "source_chunk_ids": ["1::abstract::0"], "evidence_span": "zinc heals"}])
    q = spark.createDataFrame([("does zinc heal wounds", ["1"]), ("silver spoon", ["2", "9"]), ("silver ring", ["1"])], "question string, relevant_pmids array<string>")
    got = {r["strategy"]: tuple(r)[1:] for r in library.evaluate(q, k=1, claims_k=1).collect()}
    assert got["chunks"] == got["mixed"] or got["chunks"][:2] == (3, 0.667)
    by_hand = {}
    for s in ("chunks", "claims", "merged", "mixed"):
        hits, recalls, mrrs = [], [], []
        for r in q.collect():
            found = library.ask(r["question"], k=1, claims_k=1, strategy=s).join(library.index().scores(r["question"].split()).select("id"), "id", "left_semi")
            pmids = list(dict.fromkeys(x["pmid"] for x in found.orderBy("part", F.desc("score")).collect()))
            places = [i for i, p in enumerate(pmids, 1) if p in r["relevant_pmids"]]
            hits.append(bool(places))
            recalls.append(len(places) / len(r["relevant_pmids"]))
            mrrs.append(1 / places[0] if places else 0)
        by_hand[s] = tuple(round(sum(x) / 3, 3) for x in (hits, recalls, mrrs))
    assert {s: v[1:] for s, v in got.items()} == by_hand


def test_settings(tmp_path, monkeypatch):
    monkeypatch.delenv("QUILLSTONE_HOME", raising=False)
    s = Settings(tmp_path / "s")
    assert s.home(here=tmp_path) == str(tmp_path / "s" / "default")
    s.register("a", "/a")
    s.register("b", "/b", use=True)
    assert s.home(here=tmp_path) == "/b" and s.home(name="a") == "/a" and s.home("/c", "a") == "/c"
    (tmp_path / ".quillstone").write_text("name:a\n")
    assert s.home(here=tmp_path) == "/a"
    (tmp_path / ".quillstone").write_text("name:gone\n")
    assert s.home(here=tmp_path) == "/b"
    monkeypatch.setenv("QUILLSTONE_HOME", "/env")
    assert s.home(here=tmp_path) == "/env"
    (tmp_path / "s" / "homes.json").write_text("{broken")
    with pytest.raises(LibraryError):
        s.home(name="a")


def test_stated_lists_and_author(tmp_path):
    assert stated('[{"text": "a"}]', "claims") == [{"text": "a"}] and stated("[]", "claims") == []
    for bad in ("{broken", '{"text": "a"}', '["a"]', "null", ""):
        with pytest.raises(LibraryError) as e:
            stated(bad, "claims")
        assert e.value.payload["error"] == "invalid_input"
    s = Settings(tmp_path)
    assert s.author() is None and s.author("Roe") == "Roe"
    s.write("config.json", {"author_name": "Doe"})
    assert s.author() == "Doe" and s.author("Roe") == "Roe" and s.author("") == ""


def test_files_of_a_home(spark, tmp_path):
    home = f"file://{tmp_path}"
    schema = PAPERS.removeprefix("doc_key string, ")
    assert files.scan_records(spark, home, schema).columns == ["doc_key", *[f.split()[0] for f in schema.replace("array<struct<family:string,given:string>>", "x").split(", ")]]
    assert files.scan_records(spark, home, schema).count() == files.listed(spark, f"{home}/none").count() == 0
    for key, text in {"b+1 c": '{"title": "T", "year": 2019, "tags": ["x"], "doc_key": "other"}', "a": '{"title": "U",\n "more": 1}', "broken": '{"title": "T"', "list": "[1]", "empty": "", "word": '"x"'}.items():
        (tmp_path / "papers" / key).mkdir(parents=True)
        (tmp_path / "papers" / key / "metadata.json").write_text(text)
    (tmp_path / "papers" / "none").mkdir()
    (tmp_path / "papers" / "bytes").mkdir()
    (tmp_path / "papers" / "bytes" / "metadata.json").write_bytes(b"\xff\xfe{")
    got = files.scan_records(spark, home, schema).collect()
    assert [(r["doc_key"], r["title"], r["year"], r["tags"]) for r in got] == [("a", "U", None, None), ("b+1 c", "T", "2019", ["x"])]
    (tmp_path / "papers" / "a" / "more").mkdir()
    (tmp_path / "papers" / "a" / "more" / "x.bin").write_bytes(b"12345")
    sizes = {r["folder"].rsplit("/", 1)[1]: (r["n_files"], r["length"]) for r in files.folder_sizes(files.listed(spark, home)).collect()}
    assert sizes["more"] == (1, 5) and sizes["list"] == (1, 3)


def test_figures_are_listed_by_number(spark):
    rows = [("p", f"x/{n}") for n in ("fig_10.png", "fig_2.png", "fig_2.jpg", "my_fig_1.png", "fig_x.png", "fig_1.png")] + [("q", "fig_0.png"), ("r", "none.png"), (None, "fig_3.png"), ("s", None)]
    got = {r["doc_key"]: r["figures"] for r in files.figure_files(spark.createDataFrame(rows, "doc_key string, path string")).collect()}
    assert got == {"p": ["x/fig_1.png", "x/fig_2.png", "x/fig_10.png"], "q": ["fig_0.png"], None: ["fig_3.png"]}


def test_id_lists(spark):
    got = files.id_lists(spark.createDataFrame([("f", " 3 \r\n\n1\n3\n\t"), ("g", None), ("h", "")], "name string, text string")).collect()
    assert [tuple(r) for r in got] == [("f", 0, "3"), ("f", 1, "1")]


def test_descriptors_and_kept_downloads(spark, tmp_path):
    record = "<DescriptorRecord><DescriptorUI>{0}</DescriptorUI><DescriptorName><String>{1}</String></DescriptorName><ConceptList>{2}</ConceptList></DescriptorRecord>"
    concept = lambda *terms: "<Concept><TermList>" + "".join(f"<Term><String>{t}</String></Term>" for t in terms) + "</TermList></Concept>"
    body = "<DescriptorRecordSet>" + record.format("D1", "Zinc", concept("Zinc", "Zn") + concept("Zincum")) + record.format("D2", "Iron", concept("Iron")) + record.format("D3", "Bare", "") + "</DescriptorRecordSet>"
    asked = []

    def transport(url, params):
        asked.append(url)
        return (200, {}, body.encode()) if len(asked) != 2 else (404, {}, b"")

    client, at = Client(transport, sleep=lambda s: None), tmp_path / "sets" / "desc.xml"
    assert files.downloaded(client, "u", at) == at == files.downloaded(client, "u", at) and len(asked) == 1
    with pytest.raises(RemoteError):
        files.downloaded(client, "u", at, force=True)
    assert at.read_text() == body and [p.name for p in at.parent.iterdir()] == ["desc.xml"]
    got = sorted(tuple(r) for r in files.descriptors(spark, f"file://{at}").select("ui", "heading", F.coalesce("term", F.lit("-"))).collect())
    assert got == [("D1", "Zinc", "Zinc"), ("D1", "Zinc", "Zincum"), ("D1", "Zinc", "Zn"), ("D2", "Iron", "Iron"), ("D3", "Bare", "-")]


PAGES = {0: ["1", "2"], 2: ["2", "3"], 4: ["4", "5"]}


def served(url, params):
    return 200, {}, json.dumps({"esearchresult": {"count": "6", "idlist": PAGES.get(params["retstart"], [])}}).encode()


def test_paging_as_a_source(spark):
    spark.dataSource.register(SearchSource)
    read = spark.read.format("paged_search").option("transport", "tests.test_library:served").option("query", "q").option("page", "2").option("persecond", "1000")
    from quillstone.operators.search import pages_merged

    assert [r["pmid"] for r in pages_merged(read.load()).orderBy("pos").collect()] == ["1", "2", "3", "4", "5"]


def test_retries():
    answers, slept = [(429, {"Retry-After": "7"}, b""), OSError("down"), (503, {}, b""), (200, {}, b"ok")], []

    def transport(url, params):
        a = answers.pop(0)
        if isinstance(a, OSError):
            raise a
        return a

    c = Client(transport, sleep=slept.append, clock=lambda: 0.0)
    assert c.get("u", {}) == b"ok" and 7.0 in slept
    with pytest.raises(RemoteError, match="404"):
        Client(lambda u, p: (404, {}, b""), sleep=slept.append).get("u", {})
    with pytest.raises(RemoteError, match="after 2 tries"):
        Client(lambda u, p: (500, {}, b""), tries=2, sleep=slept.append).get("u", {})
    with pytest.raises(ValueError):
        next(Client(served).pages("u", " "))
    assert full_text([("package", lambda k: None), ("xml", lambda k: b"x")], "1") == ("xml", b"x") and full_text([], "1") == ("metadata", None)
    with pytest.raises(RemoteError):
        full_text([], "1", required=True)


def test_streams(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/home")
    from quillstone.library import _shaped

    _shaped(rows_of(spark, "1", ["a b", "c d"])).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        ingest_files(lib, f"{tmp_path}/in", f"{tmp_path}/ck").awaitTermination()
    assert lib.rows().count() == 2 and lib.rows().schema.simpleString() == spark.createDataFrame([], ROWS).schema.simpleString()
    lib.log_search("l", "q", ["1"], 5)
    lib.log_search("l", "q", ["1", "2"], 5)
    q = searches_by_hour(spark, f"{lib.root}/searches", SEARCHES).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("hours").agg(F.sum("n"), F.sum("hits")).first()[:] == (2, 10)


def test_pages_and_attachments(spark, tmp_path):
    steps = spark.createDataFrame([(1, "<b>", 5), (2, "x", None)], "step int, concept string, total_count int")
    out = render.funnel_page(steps, "A & B")
    assert "&lt;b&gt;" in out and "A &amp; B" in out and "<td></td>" in out
    assert "<\\/script>" in render.triage_page(spark.createDataFrame([("</script>",)], "title string"), "t")
    with pytest.raises(ValueError, match="narrower"):
        render.triage_page(spark.range(80), "t")
    assert render.json_rows(steps).where("json LIKE '%total_count%'").count() == 1
    with pytest.raises(LibraryError):
        attach_pdf(tmp_path, "1", b"x")
    (tmp_path / "1").mkdir()
    assert attach_pdf(tmp_path, "1", b"x").read_bytes() == b"x"
    with pytest.raises(LibraryError):
        attach_pdf(tmp_path, "1", b"y")
    assert attach_pdf(tmp_path, "1", b"y", force=True).read_bytes() == b"y"


JATS = """<?xml version="1.0" encoding="UTF-8"?><!DOCTYPE article PUBLIC "-//X//DTD" "x.dtd"><article><front><journal-meta><journal-title>J</journal-title></journal-meta><article-meta><article-id pub-id-type="pmid">{key}</article-id>
<title-group><article-title>On <italic>zinc</italic></article-title></title-group><contrib-group><contrib contrib-type="author"><name><surname>Roe</surname><given-names>Jo</given-names></name></contrib></contrib-group>
<pub-date><year>2020</year></pub-date><abstract><p>Zinc heals.</p></abstract></article-meta></front><body><p>Before any heading.</p><sec><title>Results</title><p>Zinc works <fig><label>Figure 1</label><caption><p>Wounds</p></caption></fig> well.</p>
<sec><title>Mice</title><p>{words}</p><p>Short end.</p><fig/></sec></sec><sec><title>References</title><p>Nobody 1999.</p></sec></body></article>"""


def test_articles(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/a", parts=4)
    words = " ".join(f"w{i}" for i in range(500))
    given = [("1", JATS.format(key="1", words=words), None, ["t"]), ("2", "<article><broken", None, None), ("3", None, "<PubmedArticle><MedlineCitation><PMID>3</PMID><Article><ArticleTitle>Bare</ArticleTitle><Abstract><AbstractText>Only this.</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>", None)]
    assert lib.ingest_articles(spark.createDataFrame(given, "doc_key string, xml string, record string, tags array<string>")) == {"rows": 9, "papers": 2}
    rows = {r["id"]: r for r in lib.rows().collect()}
    assert rows["1::text::0"]["text"] == "Before any heading." and rows["1::text::0"]["section"] is None
    assert rows["1::text::1"]["text"] == "Results\nZinc works well." and rows["1::text::2"]["section"] == "Results > Mice"
    body = [rows[f"1::text::{i}"]["text"].removeprefix("Results\nMice\n") for i in (2, 3, 4)]
    assert " ".join(body).split() == [*words.split(), "Short", "end."] and all(len(t.split()) <= 384 for t in body)
    assert rows["1::fig::0"]["text"] == "Figure 1 Wounds" and rows["1::fig::1"]["text"] == "(uncaptioned figure)"
    assert rows["1::abstract::0"]["text"] == "Zinc heals." and rows["1::text::0"]["tags"] == ["t"] and rows["3::abstract::0"]["title"] == "Bare"
    papers = {r["doc_key"]: r for r in lib.papers().collect()}
    assert papers["1"]["title"] == "On zinc" and papers["1"]["authors"][0]["family"] == "Roe" and papers["1"]["has_fulltext"] and not papers["3"]["has_fulltext"] and not papers["2"]["has_fulltext"]
    assert lib.ingest_articles(spark.createDataFrame(given[:1], "doc_key string, xml string, record string, tags array<string>")) == {"rows": 0, "papers": 0}
    lib.ingest_articles(spark.createDataFrame([("1", JATS.format(key="1", words="few"))], "doc_key string, xml string"), force=True)
    assert sorted(r["id"] for r in lib.rows().where("doc_key = '1' AND type = 'text'").collect()) == ["1::text::0", "1::text::1", "1::text::2"]
    files = spark.createDataFrame([("1", "source.pdf", 2_000_000), ("1", "source.xml", 5)], "doc_key string, name string, length long")
    first, bare = (r for r in lib.dashboard(files=files).where("doc_key IN ('1', '3')").orderBy("doc_key").collect())
    assert (first["authors"], first["pdf_size"], first["has_xml"], first["n_figures"], first["cover"], first["figures"]) == ("Roe", "1.9 MB", True, 2, "figs/1.png", ["figs/1_0.png", "figs/1_1.png"])
    assert (bare["has_pdf"], bare["pdf_size"], bare["n_chunks"], bare["claims"], bare["figures"]) == (False, None, 1, [], []) and len(lib.dashboard().columns) == 30
    lib.remove(["1"])
    assert {r["doc_key"] for r in lib.papers().collect()} == {"2", "3"}


def hits(url, params):
    """A service whose every clause halves the hits of 40."""
    n = 40 >> params["term"].count(" AND ") - 1
    ids = [str(i) for i in range(n)][params["retstart"] : params["retstart"] + params["retmax"]]
    return 200, {}, json.dumps({"esearchresult": {"count": str(n), "idlist": ids}}).encode()


def test_a_search_from_concepts_to_ids(spark, tmp_path):
    lib, client = Library(spark, f"file://{tmp_path}/s"), Client(hits, per_second=1e9)
    concepts = [S.Concept("metal", ["zinc", "zn"]), S.Concept("effect", ["wound healing"]), S.Concept("extra", ["mice"], required=False)]
    found = lib.search(client, "u", "first", concepts=concepts, most=7, page=3, steps=True)
    assert found["pmids"] == [str(i) for i in range(7)] and (found["total_count"], found["truncated"]) == (10, True)
    assert [(s["concept"], s["total_count"]) for s in found["funnel"]] == [("metal", 40), ("effect", 20), ("extra", 10)] and found["funnel"][-1]["query"] == found["query"]
    assert found["query"] == '((zinc[Title/Abstract] OR zn[Title/Abstract]) AND "wound healing"[Title/Abstract] AND mice[Title/Abstract]) AND English[Language]' and len(found["warnings"]) == 2
    broad = lib.search(client, "u", "second", project="p/q", concepts=concepts, sensitivity="broad", headings={"zinc": "Zinc"})
    assert broad["total_count"] == 20 and not broad["truncated"] and "Zinc[MeSH Terms]" in broad["query"] and broad["funnel"] == [] and not broad["warnings"]
    assert lib.search(client, "u", "third", query=" a\nb ")["query"] == "(a b) AND English[Language]"
    assert sorted((r["project"] or "", r["label"], r["returned_count"]) for r in lib.searches().collect()) == [("", "first", 7), ("", "third", 40), ("p/q", "second", 20)]
    for bad in ({}, {"query": "a", "concepts": concepts}, {"query": "a", "most": 0}, {"concepts": concepts, "sensitivity": "loose"}):
        with pytest.raises(ValueError):
            lib.search(client, "u", "bad", **bad)


def test_projects(spark, library):
    assert library.create_project("p")["project"] == "p"
    with pytest.raises(LibraryError):
        library.create_project("p")
    library.add_members("p", ["2"], "manual")
    assert {r["doc_key"] for r in library.ask("zinc", project="p").collect()} == {"2"}
    # scores in a project are those of a library of its papers alone
    own = library.index("p")
    alone = R.term_stats(R.postings(library.project_rows("p")), R.corpus_stats(library.project_rows("p")))
    assert {r["term"]: round(r["idf"], 9) for r in own.idf().collect()} == {r["term"]: round(r["idf"], 9) for r in alone.collect()} and own.n == 3
    text = {"5": JATS.format(key="5", words="zinc again").encode()}
    decisions = spark.createDataFrame([("1", True), ("5", True), ("6", True), ("7", False)], "pmid string, included boolean")
    done = library.ingest_included("p", "first", decisions, [("web", text.get)])
    assert (done["n_included"], done["n_already_in_library"], done["n_newly_ingested"], done["n_members_added"]) == (3, 1, 1, 2) and [f["doc_key"] for f in done["failed"]] == ["6"]
    info = library.project_info("p")
    assert [m["doc_key"] for m in info["members"]] == ["1", "2", "5"] and info["n_members"] == 3 and info["last_synced_at"] and info["searches"] == []
    assert library.remove_members("p", ["1", "9"]) == {"removed": ["1"], "not_members": ["9"]} and library.dashboard("p").select("doc_key").collect()[0][0] == "5"
    with pytest.raises(LibraryError):
        library.remove_members("p", ["9"])
    got = library.ingest_papers(["5", "8"], [("web", text.get)], required=True)
    assert [r.get("error") for r in got] == ["already_ingested", "no_open_access_fulltext"]


def test_readers_keep_their_rows_and_vacuum_takes_old_states(spark, library):
    rows, asked, top = library.rows(), library.ask("does zinc heal wounds"), library.lexical("silver", 2)
    index = library.index()
    want = [sorted(map(str, df.collect())) for df in (rows, asked, top, index.postings)]
    library.ingest(rows_of(spark, "7", ["zinc again", "and silver"]))
    library.remove(["1"])
    library.ingest(rows_of(spark, "2", ["another text", "of two rows"]), force=True)
    assert [sorted(map(str, df.collect())) for df in (rows, asked, top, index.postings)] == want
    held = set(library.store.files.names(f"{library.store.root}/data"))
    assert library.vacuum() == 0 and len(library.store.numbers()) == 4
    assert library.vacuum(-1) > 0 and len(library.store.numbers()) == 1
    left = set(library.store.files.names(f"{library.store.root}/data"))
    assert left < held and left == {c for t in library.store.manifest()["tables"].values() for c in t.values()}
    assert sorted(r["doc_key"] for r in library.rows().select("doc_key").distinct().collect()) == ["2", "7"]


def test_a_change_that_is_cut_short_anywhere_changes_nothing(spark, library, monkeypatch):
    """Stops at each write of a change in turn: what a library reads then is as before, and the change made again is as made once."""
    from quillstone.sources import versions

    state = lambda: (sorted(map(str, library.rows().collect())), library.store.manifest(), sorted(map(str, library.lexical("zinc", 3).collect())))
    before, put, publish = state(), versions.Parts.put, versions.Parts.publish
    steps = 0
    while True:
        left = [steps]

        def stop(f, left=left):
            def run(self, *args):
                if left[0] == 0:
                    raise InterruptedError
                left[0] -= 1
                return f(self, *args)

            return run

        monkeypatch.setattr(versions.Parts, "put", stop(put))
        monkeypatch.setattr(versions.Parts, "publish", stop(publish))
        try:
            library.ingest(rows_of(spark, "9", ["zinc zinc zinc", "copper"]))
            break
        except InterruptedError:
            steps += 1
            assert state() == before
        finally:
            monkeypatch.setattr(versions.Parts, "put", put)
            monkeypatch.setattr(versions.Parts, "publish", publish)
    assert steps == 6  # rows, forward, terms, sizes, blocks, manifest
    rows = library.rows()
    stats = R.corpus_stats(rows).first()
    index = library.index()
    assert (index.n, index.avgdl) == (stats["n"], stats["avgdl"]) and library.lexical("zinc", 1).first()["id"] == "9::abstract::0"
    assert sorted(index.postings.select("id", "term", "tf", "dl").collect()) == sorted(R.postings(rows).collect())


def test_projects_keep_their_time_and_model(spark, library, tmp_path):
    library.create_project("p")
    library.add_members("p", ["1"], "manual")
    made = library.projects().where("project = 'p'").first()
    library.create_project("p", force=True)
    again = library.projects().where("project = 'p'").first()
    assert again["created_at"] == made["created_at"] and again["n_members"] == 1
    other = Library(spark, library.root, model="BAAI/bge-m3")
    with pytest.raises(LibraryError) as e:
        other.sync("p")
    assert e.value.payload == {"error": "embedding_model_mismatch", "pinned": "BAAI/bge-small-en-v1.5", "main_home_model": "BAAI/bge-m3"}
    with pytest.raises(LibraryError, match="main_collection_missing"):
        other.sync("p", full=True)
    assert other.projects().where("project = 'p'").first()["model"] == "BAAI/bge-m3"
    other.ingest(rows_of(spark, "1", ["zinc", "gold"]))
    assert other.sync("p") == {"pruned": [], "no_chunks": []}


def test_pruned_top_is_the_whole_top(spark, tmp_path, monkeypatch):
    """Questions of any length over blocks of two postings, with filters, kinds and a mean length that has moved since: as with every posting scored."""
    import random

    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    rows = [(f"{k:03d}", k % 7 == 0, k % 5, " ".join(rng.choices(words, [1 / (n + 1) for n in range(60)], k=rng.choice([1, 4, 12, 60])))) for k in range(400)]
    df = spark.createDataFrame(rows, "id string, claim boolean, page int, text string").withColumn("seq", F.abs(F.xxhash64("id")) % 50)
    monkeypatch.setattr(R, "BLOCK", 2)
    index = R.write_index(df, f"file://{tmp_path}/i", 3, F.col("claim").cast("int"))
    assert index.blocks.agg(F.max(F.size("posts"))).first()[0] == 2
    assert index.floor >= 0
    for avgdl in (index.avgdl, index.avgdl * 3, index.avgdl / 4):
        moved = R.Index(index.blocks, index.terms, index.forward, index.rows, index.n, avgdl, index.floor)
        for query, k, where, kinds in (["w0"], 3, None, None), (["w59", "w1", "w1"], 5, None, [1]), (rng.choices(words, k=12), 4, F.col("page") == 2, None), (["w3", "none"], 9, F.col("page") < 2, [0]), (words, 20, None, None):
            got = [(r["id"], r["score"]) for r in moved.top(query, k, where, kinds).orderBy("lex_rank").collect()]
            every = index.rows.join(moved.scores(query), "id").withColumn("score", F.round("score", 9)).where(F.lit(True) if where is None else where)
            every = every.where(F.lit(True) if kinds is None else F.col("claim").cast("int").isin(kinds))
            assert got == [(r["id"], r["score"]) for r in every.orderBy(F.desc("score"), "seq", "id").limit(k).collect()]
    blocks, bounds = index.bounds(index.asked(["w0"]), 3)
    assert index.sources(blocks, bounds).count() < index.blocks.where("term = 'w0'").count() / 4


def test_evaluation_has_both_legs(spark, tmp_path):
    vectors = {"zinc": [1.0, 0.0, 0.1], "gold": [0.0, 1.0, 0.1], "iron": [0.3, 0.3, 0.9], "lead": [0.7, 0.7, 0.0]}
    lib = Library(spark, f"file://{tmp_path}/h")
    for key, texts in (("1", ["zinc heals wounds", "gold coins shine"]), ("2", ["iron rusts", "lead is heavy", "zinc and lead"]), ("3", ["silver spoon", "gold"])):
        lib.ingest(rows_of(spark, key, texts))
    lib.add_claims("1", [{"text": "Zinc heals", "source_chunk_ids": ["1::abstract::0"], "evidence_span": "zinc heals"}])
    lib.add_claims("2", [{"text": "Iron rusts", "source_chunk_ids": ["2::abstract::0"], "evidence_span": "iron rusts"}, {"text": "Lead is heavy", "source_chunk_ids": ["2::text::0"], "evidence_span": "lead is heavy"}])
    of = [(r["id"], next((v for w, v in vectors.items() if w in r["text"].lower()), [0.5, 0.1, 0.5])) for r in lib.rows().collect()]
    lib.tables.write("vectors", spark.createDataFrame(of, "id string, v array<float>"))
    questions = [("zinc", ["1"], vectors["gold"]), ("heavy lead coins", ["2", "3"], vectors["iron"]), ("nothing of it", ["9"], vectors["lead"])]
    ranked = R.evaluate(lib.index(), spark.createDataFrame([(k, q, v) for k, (q, _, v) in enumerate(questions)], "qid long, text string, vector array<double>"), 2, 1, lib.tables.read("vectors"))
    got = {(s, q): [r["pmid"] for r in ranked.where((F.col("strategy") == s) & (F.col("qid") == q)).orderBy("rank").collect()] for s in ("merged", "chunks", "claims", "mixed") for q in range(3)}
    assert got == {(s, q): [r["pmid"] for r in lib.ask(text, 2, 1, s, vector=v).collect()] for s in ("merged", "chunks", "claims", "mixed") for q, (text, _, v) in enumerate(questions)}
    df = spark.createDataFrame([(q, p, v) for q, p, v in questions], "question string, relevant_pmids array<string>, vector array<double>")
    given = sorted(map(tuple, lib.evaluate(df, 2, 1).collect()))
    assert {r[0] for r in given} == {"merged", "chunks", "claims", "mixed"} and {r[1] for r in given} == {3}
    by_text = {q: v for q, _, v in questions}
    lib.embed = lambda q: by_text[q.split(": ", 1)[1]]
    assert sorted(map(tuple, lib.evaluate(df.drop("vector"), 2, 1).collect())) == given


def test_stated_lists_are_checked_entry_by_entry(spark, library):
    assert library.add_claims("1", '[{"text": "Zinc heals wounds", "source_chunk_ids": ["1::abstract::0"], "evidence_span": "zinc heals"}]') == 1
    before = library.store.numbers()
    for raw in ('[{"text": "x"}]', '[{"text": 1, "source_chunk_ids": []}]', '[{"text": "x", "source_chunk_ids": [3]}]', '{"text": "x"}', "no"):
        with pytest.raises(LibraryError) as e:
            library.add_claims("1", raw)
        assert e.value.payload["error"] == "invalid_input"
    assert "entry 0 of claims: source_chunk_ids" in str(pytest.raises(LibraryError, library.add_claims, "1", '[{"text": "x"}]').value.payload) and library.store.numbers() == before
    got = library.evaluate('[{"question": "does zinc heal wounds", "relevant_pmids": ["1"]}]', k=1, claims_k=1, strategies=["claims"]).collect()
    assert [(r["strategy"], r["n"], r["hit"]) for r in got] == [("claims", 1, 1.0)]
    with pytest.raises(LibraryError, match="invalid_input"):
        library.evaluate('[{"question": "q"}]')
