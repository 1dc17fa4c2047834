"""Chats, neighbours and pages."""

import collections
import math

import numpy as np
import pytest

from rankspark.llm import ann, chat, html_text

# --- chat ----------------------------------------------------------------------------------

CONV = "conv_id long, turn long, role string, text string"


def brute_path(model, rows, begins=True):
    """Viterbi over all lines of a conversation at once."""
    seen = [o for r in rows for o in chat.lines_of(model, r[3], chat.NAMES.get((r[2] or "").strip().lower(), -1))]
    return chat.decode(model, seen, begins)


def talk(n, label=True, conv=1):
    return [(conv, i, ("user" if i % 2 == 0 else "assistant") if label else None, "What is it?" if i % 2 == 0 else "It is " + "a thing " * 40) for i in range(n)]


def test_roles_are_recovered(spark):
    rows = [r for c in range(30) for r in talk(8, True, c)] + talk(8, False, 99)
    got = chat.format_chats(spark.createDataFrame(rows, CONV)).where("conv_id = 99").orderBy("turn").collect()
    assert [r.role for r in got] == ["user", "assistant"] * 4
    assert got[0].rendered == "<|user|>\nWhat is it?\n<|end|>"


def test_markers_split_a_transcript(spark):
    text = "User: hello\nhow are you?\nAssistant: fine\n### System: be kind\n<|user|> ok"
    got = chat.format_chats(spark.createDataFrame([(1, 0, None, text)], CONV)).orderBy("part").collect()
    assert [(r.role, r.content) for r in got] == [("user", "hello\nhow are you?"), ("assistant", "fine"), ("system", "be kind"), ("user", "ok")]


def test_awkward_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, "??", ""), (None, 0, None, "x"), (2, 5, "BOT ", "a\n\nb")]
    got = chat.format_chats(spark.createDataFrame(rows, CONV)).collect()
    assert len(got) == 4
    assert {(r.conv_id, r.role) for r in got} >= {(1, "user"), (2, "assistant")}
    assert chat.format_chats(spark.createDataFrame([], CONV)).count() == 0


def test_runs_of_a_long_conversation_agree_with_one_pass(spark, monkeypatch):
    import random

    rng = random.Random(2)
    rows = [(1, i, rng.choice(["user", "assistant", None, None]), rng.choice(["Why?", "Because of it. " * 9, "You must always.", "User: hi", ""])) for i in range(60)]
    df = spark.createDataFrame(rows, CONV)
    whole = [tuple(r) for r in chat.format_chats(df).orderBy("turn", "part").collect()]
    monkeypatch.setattr(chat, "RUN", 7)
    assert [tuple(r) for r in chat.format_chats(df).orderBy("turn", "part").collect()] == whole


@pytest.mark.parametrize("small", [True, False])
def test_chats_equal_whole_conversations(spark, monkeypatch, small):
    """Every row's text comes back, as from one pass over each conversation, however it is cut and joined."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(6)
    texts = ["Why?", "Because of it. " * 9, "You must always.", "User: hi\nAssistant: yes\nno", "", None, "x y " * 5000]
    rows = [(rng.choice([1, 2, None]), rng.choice([None, 1, 2, 3]), rng.choice(["user", "assistant", None, "??"]), rng.choice(texts)) for _ in range(120)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, CONV).repartition(3)
    for name in ("conv", "run", "at", "part", "given", "row", "head", "rendered"):
        df = df.withColumn(name, F.lit("x"))
    monkeypatch.setattr(chat, "RUN", 16)
    if not small:
        monkeypatch.setattr("rankspark.llm.common.BROADCAST_ROWS", 0)
    model = chat.train(chat.numbered(chat._rows(df, "conv_id", "turn", "role", "text", False)))
    given = lambda r: chat.NAMES.get((r[2] or "").strip().lower(), -1)
    expected = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, given(r), r[3] is not None, r[3] or ""))
        seen, of = [], []
        for i, r in enumerate(own):
            got = chat.lines_of(model, r[3], given(r))
            seen += got
            of += [i] * len(got)
        roles = chat.decode(model, seen, True)
        expected += [(conv, own[i][1], part, role, content) for i, part, role, content in chat.turns_of(seen, roles, of)]
    got = chat.format_chats(df, merge_repeats=False)
    assert collections.Counter((r.conv_id, r.turn, r.part, r.role, r.content) for r in got.collect()) == collections.Counter(expected)
    assert sum(t[2] == 0 for t in expected) == len(rows)


def test_rows_without_a_turn_all_count(spark):
    rows = [(1, 0, "user", "Hi"), (1, None, "user", "Yes."), (1, None, "user", "Yes."), (None, None, None, None), (None, None, None, None)]
    got = chat.format_chats(spark.createDataFrame(rows, CONV)).collect()
    assert sorted((str(r.conv_id), r.content) for r in got) == [("1", "Hi"), ("1", "Yes."), ("1", "Yes."), ("None", ""), ("None", "")]


@pytest.mark.parametrize("conv, turn", [(1, None), (None, 3), (None, None)])
def test_runs_are_bounded_whatever_the_turn_numbers(spark, monkeypatch, conv, turn):
    texts = ["Why?", "Because of it. ", "same " * 60 + "a", "same " * 60 + "b", "same " * 60, "User: hi", None]
    rows = [(conv, turn, ["user", "assistant", None][i % 3], (texts[i % 7] or "") + (str(i) if turn is not None else "") if texts[i % 7] is not None or turn is not None else None) for i in range(90)]
    rows += talk(5, True, 2)
    df = spark.createDataFrame(rows, CONV).repartition(4)
    whole = chat.format_chats(df).collect()
    assert len(whole) == len(rows)
    monkeypatch.setattr(chat, "RUN", 7)
    found = chat.numbered(chat._rows(df, "conv_id", "turn", "role", "text")).collect()
    assert max(collections.Counter((r.conv, r.run) for r in found).values()) == 7
    order = sorted((r for r in found if r.conv == conv), key=lambda r: r["at"])
    assert [(r.given, (r.text is not None, (r.text or "").encode())) for r in order] == sorted((r.given, (r.text is not None, (r.text or "").encode())) for r in order)
    got = chat.format_chats(df).collect()
    assert sorted((str(r.conv_id), r.content) for r in got) == sorted((str(r.conv_id), r.content) for r in whole)
    if turn is None:
        return
    # texts differ: the paths are as likely (two that are equally likely may be told apart differently)
    model, ends = chat.train(chat.numbered(chat._rows(df, "conv_id", "turn", "role", "text"))), []
    for result in (whole, got):
        role, total, last = {r.content: chat.ROLES.index(r.role) for r in result if r.conv_id == conv}, 0.0, 0
        for i, r in enumerate(order):
            ((e, new, at, line),) = chat.lines_of(model, r.text, r.given)
            now = role[line[at:].strip()]
            total, last = total + chat._moves(model, new, i == 0)[last][now] + e[now], now
        ends.append(total)
    assert ends[0] == pytest.approx(ends[1], rel=1e-12)


def test_decode_is_the_best_path():
    import itertools

    model = {"emit": [[math.log((s + 1) * (k + 1) % 7 + 1) for s in range(chat.SYMBOLS)] for k in range(3)], "move": [[math.log(v) for v in row] for row in ([0.2, 0.5, 0.3], [0.1, 0.2, 0.7], [0.3, 0.6, 0.1])], "start": [math.log(v) for v in (0.2, 0.5, 0.3)]}
    seen = [o for t in ("a?\nb", "You must", "c " * 100) for o in chat.lines_of(model, t, -1)]

    def score(path):
        total, last = 0.0, 0
        for i, (o, s) in enumerate(zip(seen, path)):
            total += chat._moves(model, o[1], i == 0)[last][s] + o[0][s]
            last = s
        return total

    best = max(itertools.product(range(3), repeat=len(seen)), key=score)
    assert score(chat.decode(model, seen, True)) == pytest.approx(score(best))
    m = chat.through(model, seen, True)
    assert max(map(max, m)) == pytest.approx(score(best))


# --- neighbours ------------------------------------------------------------------------------


def brute(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and len(v) == 8 and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, q in ok:
        if i % 20 == 0:
            found = sorted(((-float((v * q).sum()), j) for j, v in ok if j != i))[:k]
            out.setdefault(i, [(j, -s) for s, j in found])
    return out


def vectors(n, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.4 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(n)]
    same = rows[3][1]
    rows += [(n + i, same) for i in range(n // 3)]
    return rows + [(9000, None), (9001, [0.0] * 8), (9002, [float("nan")] * 8), (9003, [1.0, None] * 4), (9004, [float("inf")] + [1.0] * 7), (9005, [1.0]), (None, [1.0] * 8)]


def test_neighbours_reach_recall(spark):
    rows = vectors(900)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.neighbours(df, df.where("vec_id % 20 = 0"), 20, shard_rows=300).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    expected = brute(rows, 20)
    assert got.keys() == expected.keys()
    hit = sum(len({j for j, _ in got[q]} & {j for j, _ in e}) for q, e in expected.items())
    assert hit >= 0.95 * sum(map(len, expected.values()))
    exact = dict(rows)
    for q, found in got.items():
        assert all(s == pytest.approx(float(np.dot(np.array(exact[q], float), np.array(exact[j], float))), abs=1e-12) for j, s in found)
        assert found == sorted(found, key=lambda p: (-p[1], p[0])) and q not in [j for j, _ in found]


@pytest.mark.parametrize("lengths", [(1e3, 1e4, 1e6), (3.9,), (2e19, 1e30)])
def test_recall_beside_long_vectors(spark, lengths):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 8)).astype(np.float32)
    x[::2] /= np.linalg.norm(x[::2], axis=1, keepdims=True)
    for k in range(6):
        x[7 + 400 * k] *= lengths[k % len(lengths)] / np.linalg.norm(x[7 + 400 * k])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    expected, got = brute(rows, 20), {}
    for r in ann.neighbours(df, df.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = sum(len(got[q] & {j for j, _ in e}) for q, e in expected.items())
    assert hit >= 0.95 * sum(map(len, expected.values()))


def test_small_tables_are_exact(spark):
    rows = vectors(30)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.neighbours(df, df.where("vec_id % 20 = 0"), 50).orderBy("query_id", "rank").collect()
    expected = brute(rows, 50)
    assert {q: [r.vec_id for r in got if r.query_id == q] for q in expected} == {q: [j for j, _ in e] for q, e in expected.items()}
    other = spark.createDataFrame([(20, [1.0, 2.0]), (40, None)], df.schema)
    assert ann.neighbours(df, other, 5).count() == 0
    empty = df.where("false")
    assert ann.neighbours(empty, empty).count() == 0


# --- pages -----------------------------------------------------------------------------------

PAGE = (
    "<html><head><title>A title that is rather long, so that it could be taken for text</title><style>p{}</style><script>var t='</p>';</script></head><body>"
    '<header><p>Site</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- x --><div class="ad">Buy now.</div>'
    "<article><h1>Head &amp; more</h1><p>One.</p><p>Two&nbsp;&eacute;\n <b>bold</b>text</p><p>Open<p>Next<br>line</article>"
    '<aside>Other</aside><form><label>Mail</label></form><div id="comments"><p>' + "I say. " * 40 + '</p></div><div class="cookie-notice">We use cookies.</div><footer>End</footer></body></html>'
)


def test_article_of_a_page():
    assert html_text.main_text(PAGE, html_text.tree()) == "Head & more\nOne.\nTwo é boldtext\nOpen\nNext line"


def test_page_without_signs():
    body = "".join(f"<p>{'word ' * n}</p>" for n in (50, 3, 40))
    page = f"<body><ul><li><a href=a>Home</a></li><li><a href=b>All news of today</a></li></ul><div>{body}</div><p><a href=c>Back to the start</a></p></body>"
    assert html_text.main_text(page, html_text.tree()).count("word") == 93
    assert "Home" not in html_text.main_text(page, html_text.tree())


def test_tree_fits_its_table():
    tree, wrong, total = html_text.tree(), 0, 0
    for page in html_text._labelled():
        found = html_text.blocks(page)
        wrong += sum(html_text.keeps(tree, x) != b[0].startswith("=") for b, x in zip(found, html_text.features(found)))
        total += len(found)
    assert wrong < 0.02 * total


@pytest.mark.parametrize("page", ["", "<", "<p", "a < b", "<!-- open", "<script>x", "</p></div>", "<p class='x", "&amp", "<div>" * 3000 + "x", "\x00<p>퟿</p>"])
def test_broken_pages(page):
    html_text.main_text(page, html_text.tree())


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")], "page_id long, url string, html string")
    got = html_text.extract(df).collect()
    assert sorted(r.n_chars for r in got)[:2] == [0, 0] and len(got) == 4
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(df.where("false")).count() == 0


def test_held_out_pages_of_the_labelled_table():
    """Trained on three quarters of the pages, the tree is right on the fourth."""
    pages = html_text._labelled()
    for fold in range(4):
        weights, tree = html_text.train([p for i, p in enumerate(pages) if i % 4 != fold])
        found = [html_text.blocks(p) for i, p in enumerate(pages) if i % 4 == fold]
        pairs = [(html_text.keeps(tree, x), b[0].startswith("=")) for f in found for b, x in zip(f, html_text.features(f, weights))]
        right = sum(a and b for a, b in pairs)
        assert right >= 0.97 * sum(a for a, _ in pairs) and right >= 0.97 * sum(b for _, b in pairs)


def brute_article(page):
    """A plain reading of the article element of the generated pages."""
    import html
    import re

    found = re.search(r"<article>(.*?)</article>", page or "", re.S)
    body = re.sub(r"<!--.*?-->|<script.*?</script>|<style.*?</style>", "", found.group(1), flags=re.S) if found else ""
    parts = re.split(r"</?(?:p|h1|h2|h3|div|ul|li|nav|footer|header|blockquote)\b[^>]*>", body)
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", q))).split()) for q in parts]
    return "\n".join(q for q in parts if q)


def test_pages_against_a_plain_reading(spark):
    rows = html_text.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), keep=("page_id", "url", "html")).collect()
    assert len(rows) == 250 and all(r.text == brute_article(r.html) for r in rows)


def test_names_that_only_look_like_surroundings():
    page = (
        '<nav><a href="/">Home</a></nav><article><h1>T</h1><p>One.</p><section class="comment-policy"><p>We talk of rules for comments here.</p></section><p class="more">More of it.</p>'
        '<div class="share-price">The price rose.</div><math><mi>x</mi></math><noscript>Plain</noscript><svg><text>label</text></svg><object>Shown</object><xmp><b>raw</b> &amp;</xmp></article>'
        '<section class="comments"><p>' + "I say so. " * 20 + "</p></section>"
    )
    assert html_text.main_text(page, html_text.tree()) == "T\nOne.\nWe talk of rules for comments here.\nMore of it.\nThe price rose.\nxPlainlabelShown\n<b>raw</b> &amp;"


def test_repeated_queries_are_asked_once(spark):
    """A query row that occurs twice keeps its k results; two vectors under one id have k each."""
    rows = vectors(300)
    at = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([rows[20], rows[20], rows[40], (40, rows[41][1])], "vec_id long, embedding array<float>")
    got = ann.neighbours(at, queries, 5).collect()
    assert len([r for r in got if r.query_id == 20]) == 5 and len({r.vec_id for r in got if r.query_id == 20}) == 5
    assert len([r for r in got if r.query_id == 40]) == 10
