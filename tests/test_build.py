"""From HTML to graphs, on small documents written for these tests."""

import json

import pytest
from pyspark.sql import functions as F

from spindle.functions import components as C
from spindle.functions import dom, lexer, utilities
from spindle.operators import build, checks, reads, tokens
from spindle.sources import html as H
from spindle.sources import store
from spindle.streaming import incremental

APP = """<!DOCTYPE html><html><head><title>Shop front</title><style>.card { padding: 12px; color: #ffb81c } input:focus { color: #ffb81c }</style></head><body><script>
const MENU_ITEMS = [{ title: 'Opening hours', icon: Icon.x, key: 'some_key' }, { hint: "Call us" }];
const C = { a: '#ffb81c', b: '#22c55e', c: '#60a5fa', d: '#a78bfa' };
const base = { gap: '8px', color: 'red' };
function PriceTag({ label, kind = 'plain', ...rest }) {
  const [hov, setHov] = useState(false);
  return (<span className="badge card flex px-2" style={{ color: C.a, padding: '12px' }} onMouseEnter={() => setHov(true)} onMouseLeave={() => setHov(false)}>Price label</span>);
}
const CartItem = ({ item }) => (
  <div style={{ ...base, color: '#ffb81c', border: `1px ${x ? 'a' : 'b'}` }} onMouseEnter={e => { e.currentTarget.style.opacity = '0.5'; }} onMouseLeave={e => { e.currentTarget.style.opacity = '1'; }}>
    <svg viewBox="0"><path d="M0 0"/></svg><PriceTag label="x"/> /* not { a brace */ <h3>Your cart holds</h3>
  </div>
);
function helper(a) { return a + 1; }
function HomePage() {
  return (<main>{/* -- Header -- */}<NavBar/><h1>Welcome home</h1>{/* Items */}<CartItem/><UI.PriceTag /></main>);
}
const CardView = () => { return <HomePage/>; };
</script></body></html>"""
PLAIN = """<html><head><title>my plain site</title><style>p{margin:8px} .x{margin:8px} .y{padding:9px}</style></head><body><nav><a href="/">Start here</a></nav>
<section id="our-team"><div class="card"><img><h3>A</h3><p>B</p><button>Go</button></div><div class="card"><img><h3>A</h3><p>B</p><button>Go</button></div><div class="card"><img><h3>A</h3><p>B</p><button>Go</button></div></section></body></html>"""


def documents(spark, **html):
    rows = spark.createDataFrame(list(html.items()), "doc string, html string")
    return rows.withColumn("html_hash", F.md5("html"))


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("graphs"))
    assert incremental.update(documents(spark, app=APP, plain=PLAIN), root) == 2
    return root


def test_functions_and_their_ends():
    found = {f.name: f for f in lexer.functions(APP)}
    assert list(found) == ["PriceTag", "CartItem", "HomePage", "CardView"]
    assert lexer.returned(APP[found["CartItem"].start : found["CartItem"].end]).endswith("</div>")
    assert lexer.functions("// function Nope() {}\nconst s = 'function Neither() {}';") == []
    assert lexer.closing("{ a: '}', /* } */ b: { c } }", 0) == 28
    assert lexer.split("a, f(b, c), 'd, e', {g: h, i}") == ["a", " f(b, c)", " 'd, e'", " {g: h, i}"]


def test_components_of_code():
    found = {c["name"]: c for c in C.components(APP)}
    assert set(found) == {"PriceTag", "CartItem", "HomePage", "CardView"}
    tag, item, home = found["PriceTag"], found["CartItem"], found["HomePage"]
    assert [(p["prop_name"], p["default_value"]) for p in tag["props"]] == [("label", ""), ("kind", "plain")]
    assert {(s["property"], s["value"]) for s in tag["styles"]} == {("color", "#ffb81c"), ("padding", "12px")}
    assert {(s["state"], s["property"], s["value"]) for s in item["styles"]} == {("default", "gap", "8px"), ("default", "color", "#ffb81c"), ("default", "border", "`1px ${x ? 'a' : 'b'}`"), ("hover", "opacity", "0.5")}
    assert [(i["trigger"], i["css_prop"], i["from_val"], i["to_val"]) for i in item["interactions"]] == [("hover", "opacity", "1", "0.5")]
    assert item["refs"] == ["PriceTag"] and home["refs"] == ["CartItem", "NavBar", "PriceTag"]
    assert "{[icon:" in item["jsx_snippet"] and item["icons"][0]["markup"].startswith("<svg")
    assert [s["name"] for s in home["sections"]] == ["Header", "Items"] and home["screen"]
    assert tag["comp_type"] == "badge" and tag["classes"] == "badge card flex px-2"


def test_screens_by_name_and_by_tabs():
    assert [n for n in ("HomePage", "Page", "LoginForm", "SearchForm", "CardView", "View", "Screen", "UserDetail", "Card") if C.is_screen(n)] == ["HomePage", "LoginForm", "CardView", "Screen", "UserDetail"]
    tabs = "<div>{tab === 1 && <GeneralTab/>}{tab === 2 && <UsersTab x={1}/>}</div>"
    assert C.is_screen("Editor", tabs) and not C.is_screen("Editor", tabs.replace("UsersTab", "Users"))


def test_ids_are_the_first_digits_of_a_digest(spark):
    from spindle.functions.columns import entity_id

    assert spark.range(1).select(entity_id("col", F.lit("#ffb81c"))).first()[0] == "col_cb56e627" == C.entity_id("col", "#ffb81c")


def test_tags_signatures_and_names():
    root = dom.parse(PLAIN)
    counts = {}
    for own, tag in dom.patterns(root):
        counts.setdefault(own, []).append(tag)
    own = "div.card>img,h3,p,button"
    assert len(counts[own]) == 3 and dom.pattern_name(counts[own][0]) == "Card" and dom.kind(counts[own][0]) == "card"
    assert [dom.section_name(x) for x in dom.sections(root)] == ["Nav", "A"]
    assert dom.parse("<p>a<p>b<b>c</p>d").html() == "<[document]><p>a<p>b<b>c</b></p>d</p></[document]>"


def test_bundles():
    import base64
    import gzip

    files = {"a": {"data": base64.b64encode(gzip.compress(b"let x = 1")).decode(), "compressed": True, "mime": "text/javascript"}, "b": {"data": base64.b64encode(b".a{}").decode(), "mime": "text/css"}, "c": {"data": "AAAA", "compressed": True}, "d": {"data": base64.b64encode(b"<!DOCTYPE html><style>.z{}</style>").decode()}}
    assert H.unpack_bundle(json.dumps(files)) == (["let x = 1"], [".a{}"], "<!DOCTYPE html><style>.z{}</style>", 1)
    assert H.unpack_bundle("{broken") == ([], [], "", 0)


def test_tables_of_a_build(spark, graph):
    g = store.load(spark, graph, "app")
    assert {r["name"]: (r["component_count"], r["sections_count"]) for r in g.screens.collect()} == {"HomePage": (3, 2), "CardView": (0, 0)}
    assert {r["name"]: r["occurrence"] for r in g.components.collect()} == {"PriceTag": 1, "CartItem": 1, "NavBar": 0}
    assert {(r["src"], r["dst"]) for r in g.contains.collect()} == {("CartItem", "PriceTag")}
    assert {(r["src"], r["dst"]) for r in g.uses_screen.collect()} == {("CardView", "HomePage")}
    amber = g.tokens.filter("value = '#ffb81c'").first()
    assert (amber["category"], amber["label"]) == ("color", "a") and {r["src"] for r in g.uses_token.filter(F.col("dst") == amber["id"]).collect()} == {"PriceTag", "CartItem"}
    assert checks.duplicate_keys(g).count() == 0
    p = store.load(spark, graph, "plain")
    assert [r["name"] for r in p.screens.collect()] == ["MyPlainSitePage"] and {r["name"] for r in p.components.collect()} >= {"Card"}


def test_styles_of_classes_and_tags(spark, graph):
    g = store.load(spark, graph, "app")
    got = {(r["property"], r["value"], r["id"][:3]) for r in reads.hop(g.has_style, g.styles, "id", "component").filter("component = 'PriceTag'").collect()}
    assert {("padding", "12px", "cls"), ("color", "#ffb81c", "cls"), ("display", "flex", "cls"), ("padding-left", "0.5rem", "cls"), ("padding-right", "0.5rem", "cls")} <= got
    assert {(r["content"], r["text_type"], r["source"]) for r in g.texts.filter("source = 'MENU_ITEMS'").collect()} == {("Opening hours", "heading", "MENU_ITEMS"), ("Call us", "description", "MENU_ITEMS")}


def test_utility_classes():
    found = {}
    for name, _, prop, value in utilities.table():
        found.setdefault(name, []).append((prop, value))
    assert found["p-2.5"] == [("padding", "0.625rem")] and found["w-96"] == [("width", "24rem")] and found["gap-0"] == [("gap", "0px")]
    assert found["grid-cols-3"] == [("grid-template-columns", "repeat(3, minmax(0, 1fr))")] and len(found) > 700


def test_padded_sections():
    markup = '<div style={{ padding: "24px" }}>"Opening hours" "Closing time"<b/></div><div style={{ padding: "4px" }}><CartRow/></div><p/>'
    assert [(s["name"], s["detection_method"]) for s in C.sections("HomePage", markup)] == [("Opening hours", "structural")]


def test_reads_of_a_build(spark, graph):
    g = store.load(spark, graph, "app")
    assert [r["screen"] for r in reads.screens_using(g, "PriceTag").collect()] == ["HomePage"]
    assert reads.resolve_one(g.components, "cart") == "CartItem" and reads.resolve_one(g.components, " ") is None
    assert reads.full_jsx(g, "CartItem").first()[0].count("<svg") == 1
    assert reads.component_nested(g, "pricetag").first()["parents"] == ["CartItem"]
    full = reads.screen_full(g, "home").first()
    assert {c["component"] for c in full["components"]} == {"CartItem", "PriceTag", "NavBar"} and len(full["sections"]) == 2
    assert {r["check"]: r["violations"] for r in checks.validate(g).collect()}["leaf_screens"] == 0
    profile = reads.layout_profile(g, "CartItem").first()
    assert profile["gap"] == "8px" and profile["width"] is None


def test_the_last_row_of_a_document_counts(spark):
    rows = [("d", f"v{i}", f"h{i}", i) for i in (3, 7, 1, 5)] + [("e", "x", "hx", None), ("e", "y", "ha", 0)]
    docs = spark.createDataFrame(rows, "doc string, html string, html_hash string, modified int").repartition(4)
    assert {tuple(r) for r in incremental.last_rows(docs).collect()} == {("d", "v7", "h7"), ("e", "y", "ha")}
    assert {tuple(r) for r in incremental.last_rows(docs.drop("modified")).collect()} == {("d", "v7", "h7"), ("e", "x", "hx")}


def test_only_changed_documents_are_built(spark, graph):
    before = store.current(spark, graph)
    assert incremental.update(documents(spark, app=APP), graph) == 0 and store.current(spark, graph) == before
    assert incremental.update(documents(spark, plain=PLAIN.replace("my plain", "your plain")), graph) == 1
    assert [r["name"] for r in store.load(spark, graph, "plain").screens.collect()] == ["YourPlainSitePage"]
    assert store.load(spark, graph, "app").screens.count() == 2
    import time

    assert len(store.prune(spark, graph, dry_run=True, now=time.time() + 7200)) == 1 and store.prune(spark, graph) == []


def test_a_failed_build_leaves_the_graph(spark, graph):
    before = store.current(spark, graph)
    broken = build.build(documents(spark, other=PLAIN))
    broken["screens"] = broken["screens"].withColumn("name", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        store.write(broken, graph)
    assert store.current(spark, graph) == before


def test_a_stream_of_files(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "graphs")
    folder.mkdir()
    (folder / "app.html").write_text(APP)
    for _ in range(2):
        incremental.follow_files(spark, str(folder), root, str(tmp_path / "checkpoint")).awaitTermination()
        (folder / "plain.html").write_text(PLAIN)
    assert sorted(r["doc"] for r in store.documents(spark, root).collect()) == ["app", "plain"]


def test_choosing_documents():
    assert store.choose(["One", "Two"], "one.db") == "One" and store.choose(["One", "Two"], "tw") == "Two"
    assert store.choose(["One"]) == "One" and store.choose(["One", "Two"], None, "Two") == "Two"
    for names, wanted in (([], None), (["a", "b"], None), (["ab", "ac"], "a"), (["a"], "x")):
        with pytest.raises(LookupError):
            store.choose(names, wanted)


def test_tokens_of_styles(spark):
    css = "a{color:#ABC;color:#aabbcc;color:#fff;color:#fff;margin:10px;padding:6px 11px;font-size:13px;font-size:13px;font-weight:700;font-weight:700;border-radius:8 1px;border-radius:8px;--x-y: 1px;--x-y: 2px;box-shadow:0 1px 2px   red;box-shadow:0 1px 2px red}"
    rows = tokens.extract(spark.createDataFrame([("d", css)], "doc string, source string")).collect()
    got = {(r["category"], r["label"], r["value"], r["usage"]) for r in rows}
    assert got == {
        ("color", "#aabbcc", "#aabbcc", 2),
        ("spacing", "space_8", "8px", 2),
        ("typography", "text_sm", "13px", 2),
        ("typography", "weight_bold", "700", 2),
        ("radius", "radius_sm", "8px", 2),
        ("shadow", "shadow_1", "0 1px 2px red", 2),
        ("css_var", "x_y", "2px", 2),
    }


def test_rules_of_styles(spark):
    css = ".a{color:red;margin:1px}.b{x:y}.a{color:blue}input:focus, a b:hover, button:hover{border: 1px solid}"
    df = spark.createDataFrame([("d", css)], "doc string, css string")
    assert {(r["class"], r["property"], r["value"]) for r in tokens.class_rules(df).collect()} == {("a", "color", "blue"), ("b", "x", "y")}
    assert {(r["tag"], r["state"], r["value"]) for r in tokens.tag_states(df).collect()} == {("input", "focus", "1px solid"), ("button", "hover", "1px solid")}
