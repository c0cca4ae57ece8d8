"""Archives, page text and chat formatting: round trips and brute force."""

import base64
import hashlib
import html
import re
import struct

import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from gradewell.llm import chat, html_extract, warc
from gradewell.llm.common import prepared, scratch

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

# archives

PAGES = [(3, "http://a/ü\r\nx: y", "<p>same"), (1, "http://b", "<p>same"), (2, None, None), (5, "http://c%20d", ""), (7, "u", "<p>other é\r\n\r\n"),
         (None, "n", "<p>same"), (8, "v", "z" * 3_000_000), (1, "http://b", "<p>same")]


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, id string, refers_to string")


def test_archives_round_trip(spark):
    rows = warc.round_trip(prepared(spark), pages_of(spark, PAGES)).collect()
    want = []
    for page_id, url, text in PAGES:
        data = (text or "").encode()
        ids = [i for i, _, t in PAGES if (t or "") == (text or "") and i is not None]
        revisit = page_id is not None and page_id != min(ids)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((page_id, {PAGES[0][1]: "http://a/%C3%BC%0D%0Ax:%20y"}.get(url, url or ""), len(data), digest, "revisit" if revisit else "response", min(ids) if revisit else None))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_archives_min_bytes_and_empty(spark):
    rows = warc.round_trip(prepared(spark), pages_of(spark, PAGES), min_bytes=1).collect()
    assert {r["record_type"] for r in rows if r["payload_bytes"] == 0} == {"response"}
    assert warc.round_trip(spark, pages_of(spark, [])).count() == 0


def test_archive_layout(spark):
    """A dictionary in a leading skippable frame, then a frame of its own for every record."""
    path = scratch(prepared(spark), "layout")
    warc.write(spark, pages_of(spark, [(k, f"u{k}", f"<html><p>page {k} of many" * 20) for k in range(300)]).coalesce(1), path)
    archives = [r["content"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
    assert sum(len(list(warc.records(bytes(a)))) for a in archives) == 300
    for data in map(bytes, archives):
        magic, size = struct.unpack_from("<II", data)
        assert magic == 0x184D2A5D
        words = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        frames, at = 0, 8 + size
        empty = warc.EMPTY_FRAME.encode()
        for part in data[at:].split(empty):
            if part:
                one = zstandard.ZstdDecompressor(dict_data=words).decompress(part)
                assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n")
                frames += 1
        assert frames == len(list(warc.records(data)))


# page text


def plain_article(page):
    """What a page of the test tables says inside its article, without the extractor."""
    inner = re.search(r"<article>(.*)</article>", page, re.DOTALL).group(1)
    marked = re.sub(r"</?(?:p|h1)>", "\x01", inner).replace("<br>", " ")
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in marked.split("\x01"))
    return "\n".join(b for b in blocks if b)


def test_articles_of_the_test_pages(spark):
    pages = prepared(spark).read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = html_extract.main_texts(pages, html_extract.learn(pages)).collect()
    truth = {r["page_id"]: plain_article(r["html"]) for r in pages.collect()}
    assert len(got) == len(truth)
    assert [r["page_id"] for r in got if r["text"] != truth[r["page_id"]]] == []
    assert all(r["n_chars"] == len(r["text"]) for r in got)


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain text", "plain text"),
        ("<p>a<p>b", "a\nb"),
        ("<p>a &amp; b&nbsp;c\n  d</p>", "a & b c d"),
        ("a < b and <b>c</b>d", "a < b and cd"),
        ("<p>one<br>two", "one two"),
        ("<ul><li>one<li>two</ul><pre> x \n y </pre>", "one\ntwo\nx y"),
        ("<nav>menu</nav><header>top</header><main><p>It is said that.</main><footer>f</footer>", "It is said that."),
        ("<div class='ad'>buy</div><p>text here</p><div id=comments><p>first!</div>", "text here"),
        ("<aside>side</aside><p>kept words</p><form><p>name</p></form><div class='cookie-notice'>ok</div>", "kept words"),
        ("<script>if (a < b) '</p>'</script><style>p{}</style><p>seen</p><!-- <p>no</p> -->", "seen"),
        ("<p class='lead'>lead</p><p class='shadow read'>word</p>", "lead\nword"),
        ("<nav>never closed <p>inside", ""),
        ("<p>x</p></div></div><p>y", "x\ny"),
        ("<p title='a > b'>quoted</p>", "quoted"),
        ("<![CDATA[raw & kept]]>", "raw & kept"),
        ("<p>" + "w " * 50_000, ("w " * 50_000).strip()),
    ],
)
def test_page_cases(page, text):
    assert html_extract.main_text(page, html_extract.Weights()) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<div class='layout has-sidebar'><article><p>body text</article><aside>side</aside></div>", "body text"),
        ("<div id=page class='no-sidebar comments-open'><p>body text</div>", "body text"),
        ("<div class=menu-collapsed><nav>menu</nav><p>body text</div>", "body text"),
        ("<form id=aspnet><div class=sidebar>s</div><main>body text</main></form>", "body text"),
        ("<section title='the hidden cost'>body text</section><p hidden>x</p><p style='Display: none'>y</p>", "body text"),
        ("<p>body text here</p><div class=post-comments><p>nice</div>", "body text here"),
    ],
)
def test_layout_names_drop_no_article(page, text):
    assert html_extract.main_text(page, html_extract.Weights()) == text


def test_scores_of_names_are_learnt(spark):
    page = "<div class=has-menu><article><p>" + "word " * 30 + "</article><div class=post-comments>" + "talk " * 25 + "</div></div>"
    weights = html_extract.learn(pages_of(prepared(spark), [(k, "u", page) for k in range(5)]))
    assert weights.tags[".has-menu"] == -0.1 and weights.tags[".post-comments"] == -26 * weights.word
    plain = page.replace("article>", "section>")
    assert html_extract.main_text(plain, weights) == ("word " * 30).strip()


def test_links_around_the_article_are_left_out():
    weights = html_extract.Weights(1.0, 0.2, {"li": -2.0, "a": -1.0, "p": -0.1})
    page = "<ul>" + "<li><a href=x>go</a></li>" * 20 + "</ul><p>" + "content " * 30 + "</p><ul>" + "<li><a>more</a></li>" * 9 + "</ul>"
    assert html_extract.main_text(page, weights) == ("content " * 30).strip()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/abp \"'=!-&;é\n", max_size=200))
def test_any_page_gives_text(page):
    assert isinstance(html_extract.main_text(page, html_extract.Weights()), str)


def test_pages_edges(spark):
    pages = pages_of(prepared(spark), [(1, None, None), (1, None, None), (None, "u", "<p>x")])
    weights = html_extract.learn(pages)
    assert sorted((r["text"], r["n_chars"]) for r in html_extract.main_texts(pages, weights).collect()) == [("", 0), ("", 0), ("x", 1)]
    assert html_extract.main_texts(pages_of(spark, []), weights).count() == 0


# chat


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="<|>\\turnexd ", max_size=12), st.text(alphabet="<|>\\turnexd/[]s \né🙂", max_size=60)), max_size=5))
def test_templates_read_back(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for _, t in turns]


def formatted(spark, rows):
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    return chat.format_conversations(frame, VOCABULARY)


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "  lead and trail \n"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "assistant", "é🙂漢 x"),
    (2, 1, "assistant", "<|end|><|turn|>assistant<|text|>\\ <\\| <|endoftext|>"), (2, 0, "us<|text|>er", "q"), (2, None, None, "first"),
    (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (None, 0, "assistant", "no id"), (4, 0, "user", "x" * 200_000),
]


def test_masks_read_back(spark):
    made = formatted(prepared(spark), TURNS)
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    ids = {r["conv_id"]: r for r in made.collect()}
    encoder = chat._encoder(VOCABULARY)
    assert set(got) == {1, 2, 3, 4, None}
    for key, r in got.items():
        own = [("" if a is None else a, "" if b is None else b) for _, _, a, b in sorted(
            (x for x in TURNS if x[0] == key), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))]
        loss = "".join(t for role, t in own if role == "assistant")
        assert r["n_turns"] == len(own) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        text, _ = chat.render(own)
        assert ids[key]["formatted"] == text and r["formatted_chars"] == len(text)
        masked = [i for i, m in zip(ids[key]["token_ids"], ids[key]["loss_mask"]) if m]
        assert encoder.decode(masked, skip_special_tokens=False) == "".join(chat.escape(t) for role, t in own if role == "assistant")


def test_no_conversations(spark):
    assert chat.read_back(formatted(prepared(spark), [])).count() == 0


def test_hard_case(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.format_conversations(rows.unionByName(chat.hard_case(prepared(spark), rows)), VOCABULARY)).collect()
    said = "</s>[INST] ok [/INST]"
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"], r["loss_sha256"]) for r in got] == [(-7, 2, len(said), hashlib.sha256(said.encode()).hexdigest())]


def test_every_record_has_an_identifier_of_its_own(spark):
    """Null and repeated page ids too; a revisit's target is a record that exists."""
    from gradewell.llm.common import scratch

    rows = [(None, "u", "x"), (None, "u", "x"), (1, "u", "x"), (2, "u", "x"), (3, "u", "y"), (3, "u", "z"), (4, "u", "y"), (5, "u", None), (5, "u", "")]
    path = scratch(spark, "warc-ids")
    warc.write(prepared(spark), pages_of(spark, rows), path)
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").collect()
    found = [h for a in archives for h, _ in warc.records(bytes(a.content))]
    ids = [h["warc-record-id"] for h in found]
    assert len(found) == len(rows) == len(set(ids))
    targets = [h["warc-refers-to"] for h in found if h["warc-type"] == "revisit"]
    assert len(targets) == 2 and set(targets) <= set(ids)


def test_one_dictionary_from_records_of_the_whole_table(spark):
    """A very long first page doesn't decide the dictionary, and every archive begins with the same one."""
    from gradewell.llm.common import scratch

    rows = [(0, "u", "0123456789" * 400_000)] + [(k, f"u{k}", f"<html><body><p>page {k} of many pages" * 20) for k in range(1, 400)]
    path = scratch(spark, "warc-dictionary")
    warc.write(prepared(spark), pages_of(spark, rows).repartition(3), path)
    archives = [bytes(a.content) for a in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
    sizes = {int.from_bytes(a[4:8], "little") for a in archives}
    assert len(sizes) == 1 and len({a[: 8 + next(iter(sizes))] for a in archives}) == 1
    assert b"of many pages" in archives[0][: 8 + next(iter(sizes))]
