"""The text operators against brute force, on small tables with nulls, empty texts, copies and clashing names."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from vitalweave.llm import bpe, chat, decontaminate, frequent, html_extract, language, ngram_join, quality, repeats, secret_scan, token_counts
from vitalweave.llm import components as text_components
from vitalweave.llm.components import components

DOCS = "doc_id long, text string"
WORDS = [f"w{i}" for i in range(40)]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_is_the_library(spark, vocabulary):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    draw = random.Random(3)
    alphabet = [chr(c) for a, b in ((32, 127), (0x1C, 0x20), (0xA0, 0x250), (0x391, 0x3D0), (0x2000, 0x2030), (0x4E00, 0x4E10)) for c in range(a, b)]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40))) for _ in range(300)]
    texts += [None, "", " \n", "a" * 5000, "x<|endoftext|>y<|startoftext|>", "it's they'll", "ΣΑΣ İ"]
    rows = bpe.round_trip(spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("ids", F.lit("clash")), vocabulary).collect()
    for row in rows:
        ids = library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert row.ids == ids and row.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_texts(spark.createDataFrame([], DOCS), vocabulary).count() == 0


def test_chat_reads_back_what_it_formats(spark):
    rows = [(1, 2, "assistant", "b\\ <s>"), (1, 1, "user", None), (1, 1, None, "x\n[INST]"), (None, 0, "us\ner", "<|end|>\n"), (2, None, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat.digest_conversations(df).collect()}
    turns = "\nx\n[INST]\nuser\n\nassistant\nb\\ <s>\n"
    assert found[1].n_turns == 3 and found[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert (found[1].loss_chars, found[1].loss_sha256) == (6, hashlib.sha256(rb"b\ <s>").hexdigest())
    assert found[None].turns_sha256 == hashlib.sha256(b"us\ner\n<|end|>\n\n").hexdigest()
    text = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert len(text[1].text) == found[1].formatted_chars
    assert [text[1].text[s.start : s.end] for s in text[1].spans] == ["b\\\\ <\\s>"]


@pytest.mark.parametrize("source", ["{{ x.__class__() }}", "{{ f(1) }}", "{% for x in y %}", "{{ [1] }}", "{% import os %}", "{{ x | unknown }}"])
def test_templates_refuse_what_is_not_in_the_language(source):
    with pytest.raises(chat.TemplateError):
        chat.Template(source)


def test_templates_fold_constants_and_choose():
    made = chat.Template("{% if 1 == 1 %}{{ 'a' + 'b' }}{% else %}no{% endif %}{% set y = x.k %}{% if not y %}-{% elif y == 'v' %}{{ y | upper }}{% endif %}")
    assert "".join(t for t, _ in made.render({"x": {"k": "v"}})) == "abV"


def test_secrets_are_found_and_masked(spark):
    forest = secret_scan.train(secret_scan.labelled_findings(800))
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f'ü the token = "{key}" of', f"commit {key} done", "mail und.34@mail7.example.com", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    found = {r.doc_id: r.findings for r in secret_scan.scan(df, forest, ["doc_id"]).collect()}
    assert [texts[0][f.start : f.end] for f in found[0]] == [key] and not any(found[i] for i in (1, 2, 3, 4))
    masked = {r.doc_id: r.text for r in secret_scan.redact(df, forest).collect()}
    assert masked[0] == 'ü the token = "[SECRET]" of' and [masked[i] for i in (1, 2, 3, 4)] == texts[1:]
    held_out = secret_scan.labelled_findings(400, seed=11)
    scores = forest.probability(np.array([secret_scan.features(t, a, b) for t, a, b, _ in held_out]))
    assert ((scores >= 0.5) == np.array([x[3] for x in held_out])).mean() > 0.95


def test_secrets_are_candidates_in_every_form(spark):
    for text, start, end, _ in secret_scan.labelled_findings(400, seed=11):
        assert end - start < 12 or (start, end) in secret_scan.candidates(text)
    forest = secret_scan.train(secret_scan.labelled_findings(800))
    key, padded = "04dbebab91ab85687d33eeaaf9ac699e1188f962", "Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5MGFiY2RlZmdoaWprbG1ub3A=="
    forms = ["password={}", "AWS_SECRET_ACCESS_KEY={}", "https://a.b/c?token={}&x=1", "token:{}", "AccountKey={};E=1"]
    values = [key, key, key, key, padded]
    texts = [form.format(v) for form, v in zip(forms, values)]
    masked = {r.doc_id: r.text for r in secret_scan.redact(spark.createDataFrame(list(enumerate(texts)), DOCS), forest).collect()}
    assert [masked[i] for i in range(5)] == [form.format("[SECRET]") for form in forms]


def test_html_keeps_the_article_only(spark):
    page = "<nav>m</nav><div class='ad'>x</div><article><h1>T&amp;{0}</h1><p><b>a <i>b</i><br>c<p>d\n e<div id=comments>no</div></article><footer>f</footer>"
    bare = "<div class=top>Site</div><div class=body><p>text {0}</p></div><div class=end>Imprint</div>"
    rows = [(i, "http://a.com/x", page.format(i)) for i in range(4)] + [(10 + i, "http://b.com/", bare.format(i)) for i in range(6)] + [(20, None, None), (21, "x", "")]
    found = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert found[2] == "T&2\na b c\nd e" and found[13] == "text 3" and found[20] == "" == found[21]


def test_html_names_do_not_drop_the_article(spark):
    article = "<article><h1>T</h1><p>a</article>"
    pages = [
        "<article class='post no-sidebar'><h1>T</h1><p>a</article>",
        f"<div id=content class=with-sidebar>{article}</div><div class=sidebar>s</div>",
        f"<div class=sidebar>{article}</div>",
        "<article class=related><h1>T</h1><p>a</article>",
        "<article><div class=article-header><h1>T</h1></div><div class=share-price>a</div><div class=share-buttons>x</div></article>",
        "<article><div class=header><h1>T</h1></div><div class=menu-recipe>a</div><div class=site-footer>x</div></article>",
        f"{article}<div class=related><article>other</article></div>",
        "<div class=notice><h1>T</h1><p>a</div>",
    ]
    df = spark.createDataFrame([(i, f"http://h{i}.com/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_extract.extract_pages(df, ["page_id"]).collect()}
    assert found == {i: "T\na" for i in range(len(pages))}


def test_html_constant_parts_of_articles_go(spark):
    share = "<article><h1>T{0}</h1><ul><li>Share<li>Mail</ul><p class=note>Members only</p><p>text {0}</p><p>Subscribe now</p></article>"
    promo = "<article>Our app</article><div class=story><h1>T{0}</h1><p>text {0}</p></div>"
    whole = "<article><h1>Same</h1><p>text</p></article><!-- {0} -->"
    rows = [(10 * k + i, f"http://h{k}.com/", form.format(i)) for k, form in enumerate((share, promo, whole)) for i in range(6)]
    rows += [(100 + i, "http://h0.com/", share.format(100 + i)) for i in range(6)]
    rows += [(200, "http://h0.com/", "<article><h1>T</h1><ul><li>real<li>list</ul><p class=note>own note</p><p>text</article>")]
    found = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert found[200] == "T\nreal\nlist\nown note\ntext" and all(found[i] == f"T{i}\ntext {i}" and found[10 + i] == f"T{i}\ntext {i}" and found[20 + i] == "Same\ntext" for i in range(6))


def test_html_templates_of_layouts_deep_and_late(spark):
    late = "".join(f"<div class=k{chr(97 + i % 26)}{chr(97 + i // 26)}><p>{{0}} {i}</div>" for i in range(80)) + "<section>x {0}</section><div class=kaa><p>{0}</div><section>Fixed</section>"
    deep = "<div>" * 60 + "<p>text {0}</p><table><td>Fixed</table>" + "</div>" * 60
    layouts = ["<div class=top{1}>Site {1}</div><div class=mid{1}><p>text {0}</p></div>".replace("{1}", k) for k in "abc"]
    rows = [(i, "http://late.com/", late.format(i)) for i in range(6)] + [(10 + i, "http://deep.com/", deep.format(i)) for i in range(6)]
    rows += [(20 + i, "http://c.com/", layouts[i % 3].format(i)) for i in range(15)] + [(40 + i, "http://c.com/", ["", None, " "][i % 3]) for i in range(30)]
    found = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert "Fixed" not in found[3] and found[3].endswith("79\nx 3\n3") and found[12] == "text 2"
    assert all(found[20 + i] == f"text {i}" for i in range(15)) and not any(found[40 + i] for i in range(30))


def test_repeats_match_brute_force(spark):
    draw = random.Random(5)
    passage = [draw.choice(WORDS) for _ in range(70)]
    texts = [[draw.choice(WORDS) for _ in range(draw.choice((0, 20, 60, 150)))] for _ in range(30)]
    for k in (0, 3, 7, 8):
        at = draw.randrange(len(texts[k]) + 1)
        texts[k][at:at] = passage[draw.randrange(10) : 60 + draw.randrange(10)]
    texts += [texts[1], passage + passage, passage[:50]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(99, None), (100, "")]
    seen: dict = {}
    for i, t in enumerate(texts):
        for a in range(len(t) - 49):
            seen.setdefault(tuple(t[a : a + 50]), []).append((i, a))
    hit = {(i, w) for places in seen.values() if len(places) > 1 for i, a in places for w in range(a, a + 50)}
    found = repeats.repeated_spans(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r.doc_id, w) for r in found for w in range(r.first, r.end)} == hit
    assert repeats.repeated_spans(spark.createDataFrame([], DOCS)).count() == 0


def test_quality_edges(spark):
    lines = "one two three four five six seven eight nine ten.\n"
    texts = [None, "", "a b", lines, lines + "x | y | z | w\n", "A!! B!! C!! D!! E!! F!! G!! H!! I!! J!!", lines * 3]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("kept", F.lit(1))
    found = {r.doc_id: r for r in quality.assess(df).collect()}
    assert [found[i].base_failed for i in range(7)] == [True, True, True, False, False, False, True]
    assert found[6].n_dup_lines == 2 and found[6].n_repeat_words == 30
    assert found[4].kept is False and found[5].kept is False and found[3].clean_text == lines


def test_decontamination_matches_brute_force(spark):
    draw = random.Random(2)
    items = [(i, " ".join(draw.choice(WORDS[:6]) for _ in range(draw.choice((0, 1, 4, 9, 10, 11, 25))))) for i in range(12)] + [(None, "q1 q2"), (3, None)]
    texts = [" ".join(draw.choice(WORDS[:6] + ["Q1", "q2"]) for _ in range(draw.choice((0, 5, 60)))) for _ in range(40)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {r.doc_id: r for r in decontaminate.find_hits(docs, bench, ["doc_id"]).collect()}
    split = {r.doc_id: r for r in decontaminate.find_hits(docs, bench, ["doc_id"], block_bytes=30).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[a-z0-9]+", (text or "").lower())
        hit, who = set(), set()
        for item, content in items:
            other = re.findall(r"[a-z0-9]+", (content or "").lower())
            n = min(10, len(other))
            windows = {tuple(other[a : a + n]) for a in range(len(other) - n + 1)} if n else set()
            for a in range(len(words) - n + 1) if n else ():
                if tuple(words[a : a + n]) in windows:
                    hit.update(range(a, a + n))
                    who.update([] if item is None else [str(item)])
        for found in (whole[i], split[i]):
            assert {w for s in found.spans for w in range(s.first, s.end)} == hit and found.items == sorted(who) and found.n_words == len(words)


def test_token_counts(spark):
    lengths = [0, 3, 3, 700, 5, None]
    histogram = token_counts.length_histogram(spark.createDataFrame([(n,) for n in lengths], "n_tokens long"))
    known = [n or 0 for n in lengths]
    for r in token_counts.limit_table(histogram, bucket=4).collect():
        assert r.docs_up_to == sum(n <= r.n_tokens for n in known) and r.truncated_tokens == sum(min(n, r.n_tokens) for n in known)
        assert r.tokens_up_to == sum(n for n in known if n <= r.n_tokens) and r.docs_over == sum(n > r.n_tokens for n in known)
    assert {r.limit: r.truncated_tokens for r in token_counts.figures_at(histogram, [4, 1000]).collect()} == {4: 14, 1000: 711}


def test_language_id(spark):
    rows = [(i, " ".join(random.Random(i).choices(words, k=30)), lang) for i, (lang, words) in enumerate([("xx", ["abba", "cabab", "bac"]), ("yy", ["zuxo", "uzzox", "oxu"])] * 40)]
    model = language.fit(spark.createDataFrame(rows, DOCS + ", lang string"))
    docs = spark.createDataFrame([(1, "abba bac cabab"), (2, "uzzox oxu"), (3, None), (4, "123 !"), (5, "")], DOCS)
    found = {r.doc_id: r for r in language.predict(docs, model, ["doc_id"]).collect()}
    assert [found[i].lang_pred for i in range(1, 6)] == ["xx", "yy", "und", "und", "und"] and all(0 <= r.score <= 1 for r in found.values())


@pytest.mark.parametrize("few, hot, tile", [(16, 50_000, 2048), (3, 20, 7)])
def test_jaccard_components_match_brute_force(spark, monkeypatch, few, hot, tile):
    monkeypatch.setattr(ngram_join, "FEW_ROWS", few)
    monkeypatch.setattr(ngram_join, "HOT_COUNT", hot)
    monkeypatch.setattr(ngram_join, "TILE_ROWS", tile)
    draw = random.Random(few)
    texts = []
    for _ in range(8):
        base = [draw.choice(WORDS) for _ in range(draw.choice((3, 6, 30, 80)))]
        for _ in range(draw.choice((1, 4, 25))):
            own = list(base)
            for _ in range(draw.choice((0, 0, 1, 3))):
                own[draw.randrange(len(own))] = draw.choice(WORDS)
            texts.append(" ".join(own))
    texts += [None, "", " ", "A b", "a B"]
    sets = [{tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    above = list(range(len(sets)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                above[max(x, y)] = min(x, y)
    found = ngram_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {i: (len(s), root(i)) for i, s in enumerate(sets)}


def test_near_copy_stage_keeps_one_row_of_each(spark):
    draw = random.Random(8)
    bases = [" ".join(draw.choice(WORDS) for _ in range(60)) for _ in range(4)]
    near = [b + " " + draw.choice(WORDS) for b in bases]
    rows = [(2, bases[0], "a"), (1, near[0], "a"), (1, near[0], "a"), (1, near[0], "b"), (2, bases[1], "a"), (2, bases[1], "a")]
    rows += [(None, bases[2], "a"), (None, near[2], "a"), (None, bases[3], "a"), (5, near[3], "a"), (7, None, "a"), (7, None, "a"), (8, "", "a"), (None, " ", "a")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, n_chars long")
    found = [(r.doc_id, r.text, r.source) for r in corpus_pipeline.near_copy_stage(spark, docs, "").collect()]
    assert [r for r in found if r[1] in (bases[0], near[0])] in ([(1, near[0], "a")], [(1, near[0], "b")])
    assert [r for r in found if r[1] == bases[1]] == [(2, bases[1], "a")]
    assert len([r for r in found if r[1] in (bases[2], near[2])]) == 1 and [r for r in found if r[1] in (bases[3], near[3])] == [(5, near[3], "a")]
    assert len(found) == 8


@pytest.mark.parametrize("most", [3, 500_000])
def test_components_of_a_path_and_a_star(spark, monkeypatch, most):
    monkeypatch.setattr(text_components, "TASK_LINKS", most)
    links = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 110)] + [(7, 7), (None, 3)]
    found = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({found[i] for i in range(21)}) == 1 and len({found[i] for i in range(100, 110)}) == 1 and found[0] != found[100]
    assert len(found) == 31
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def test_hits_are_removed(spark):
    item = " ".join(f"i{k}" for k in range(12))
    texts = [f"a b c d e f g, h. {item} k; l m n o p q r s", item, None, "", "plain text", f"{item} x y"] * 2
    rows = [(i, t, "_d0", "c") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cleaned string, spans string")
    items = spark.createDataFrame([(1, item), (2, None), (3, "never seen words")], "item_id long, text string")
    left = decontaminate.remove_hits(df, items)
    assert left.columns == df.columns
    expected = ["a b c d e f g, h k; l m n o p q r s".replace("h k", "h. k"), None, "", "plain text"] * 2
    assert [r.text for r in left.orderBy("doc_id").collect()] == [expected[0], *expected[1:4], *expected[4:]]
    assert decontaminate.remove_hits(df.limit(0), items).count() == 0
    assert decontaminate.remove_hits(df, items.limit(0)).count() == len(rows)
    whole = "x " * 30 + item + " end" * 30
    assert decontaminate.without_words(whole.encode(), 72, [{"first": 30, "end": 42}]) == ("x " * 30 + "end" + " end" * 29).encode()


def test_near_copy_stage_keeps_columns_of_any_name(spark):
    text = " ".join(WORDS)
    docs = spark.createDataFrame([(1, text, "r", 5), (2, text, "s", 6), (3, "other words", "t", 7)], "doc_id long, text string, _row string, _n int")
    found = ngram_join.one_of_each(docs)
    assert found.columns == docs.columns and sorted(tuple(r) for r in found.collect()) == [(1, text, "r", 5), (3, "other words", "t", 7)]
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_is_the_join(spark, how):
    left = spark.createDataFrame([(1, i) for i in range(300)] + [(i % 40, i) for i in range(80)] + [(None, 1), (99, 2)], "k long, v long")
    right = spark.createDataFrame([(i, f"x{i}") for i in range(50)], "k long, w string")
    wanted = left.join(right, "k", how)
    for tracked, few in ((50, 2), (50_000, 10_000)):
        found = frequent.spread_join(left, right, "k", how, tracked, few)
        assert sorted(map(str, found.select("k", "v", "w").collect())) == sorted(map(str, wanted.collect()))


def test_html_keeps_subheadings_and_any_names(spark):
    body = "<article><h1>T{0}</h1><h2>Ingredients</h2><p>i{0} flour</p><h2>Method</h2><p>m{0} bake</p><table><tr><th>Step</th><th>Time</th></tr><tr><td>s{0}</td><td>t{0}</td></tr></table><p>All rights reserved by us</p></article>"
    rows = [(i, "http://cook.example/%d" % i, f"<html><body><div>Welcome</div>{body.format(i)}</body></html>", "h", 7) for i in range(6)]
    df = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string, _host string, _wrapper int")
    found = html_extract.extract_pages(df, ["page_id", "_host", "_wrapper"])
    assert found.columns == ["page_id", "_host", "_wrapper", "text"] and found.count() == 7
    assert {tuple(r) for r in found.collect()} == {(i, "h", 7, f"T{i}\nIngredients\ni{i} flour\nMethod\nm{i} bake\nStep\nTime\ns{i}\nt{i}") for i in range(6)}
    assert html_extract.extract_pages(df.limit(0), ["page_id"]).count() == 0


def shown(source, **scope):
    return "".join(t for t, _ in chat.Template(source).render(scope))


def test_templates_control_white_space_and_count_loops():
    assert shown("{{ -1 }}") == "-1" and shown("a {{- 1 -}} b") == "a1b" and shown("a {{ 1 }} b") == "a 1 b"
    assert shown("x \n{%- for i in xs -%} {{ i }} {%- if not loop.last -%} , {%- endif -%} {%- endfor %} y", xs=["a", "b"]) == "xa,b y"
    assert shown("{% for i in xs %}{{ loop.index }}{{ loop.first }}{% for j in i %}{{ loop.index0 }}{% endfor %}{{ loop.last }};{% endfor %}", xs=["pq", "r"]) == "1True01False;2False0True;"
    assert shown("{% for i in none %}{{ loop.index }}{% endfor %}{% for i in xs %}x{% endfor %}", xs=[]) == ""


def test_template_trees_are_folded():
    tree = chat.Template("a{{ 1 + 1 }}{% if false %}x{% elif 1 < 2 %}b{{ y }}{% else %}z{% endif %}{# c #}{% generation %}{{ '' }}{% endgeneration %}{% for i in none %}q{% endfor %}").tree
    assert [type(n).__name__ for n in tree] == ["Text", "Output"] and tree[0] == chat.Text("a2b")


def test_chat_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, extra int")
    assert chat.digest_conversations(empty).count() == 0 and chat.format_conversations(empty).count() == 0


def test_language_without_labels_and_with_repeats(spark):
    schema = "doc_id long, text string, lang string, score string, rejected int"
    empty = spark.createDataFrame([], schema)
    model = language.fit(empty)
    rows = spark.createDataFrame([(1, "some words", None, "s", 1), (1, "some words", None, "s", 1), (2, None, None, "s", 1), (3, "", "x", "s", 1)], schema)
    assert [(r.lang_pred, r.score, r.rejected) for r in language.predict(rows, model, ["doc_id", "score"]).collect()] == [("und", 0.0, True)] * 4
    assert language.fit(rows.filter("lang IS NULL OR text = ''")).languages == ()
    assert language.predict(empty, model, ["doc_id"]).count() == 0


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang IS NOT NULL AND length(text) > 100")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language.fit(docs.filter(~held), order=F.col("doc_id"))
    found = language.predict(docs.filter(held), model, ["lang"]).collect()
    assert len(found) > 100 and sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)


def test_secret_scans_of_odd_tables(spark):
    forest = secret_scan.train(secret_scan.labelled_findings(600))
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    text = f'token = "{key}" ' + "word " * 20_000 + f"password: {key}"
    rows = spark.createDataFrame([(1, text, "f", 1), (1, text, "f", 1), (2, None, None, None)], "doc_id long, text string, findings string, _new int")
    found = secret_scan.scan(rows, forest, ["doc_id", "findings"]).collect()
    spans = [[(s.start, s.end) for s in r.findings] for r in found if r.doc_id == 1]
    assert spans == [[(9, 49), (len(text) - 40, len(text))]] * 2 and [r.findings for r in found if r.doc_id == 2] == [[]]
    masked = secret_scan.redact(rows, forest)
    assert masked.columns == rows.columns and [(r.findings, r._new) for r in masked.filter("doc_id = 1").collect()] == [("f", 1)] * 2
    assert all(key not in r.text for r in masked.filter("doc_id = 1").collect())
    empty = rows.limit(0)
    assert secret_scan.scan(empty, forest, ["doc_id"]).count() == 0 and secret_scan.redact(empty, forest).count() == 0
    assert secret_scan.corpus_findings(empty) == []


def test_secret_findings_of_the_corpus_are_bounded_and_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    drawn = secret_scan.corpus_findings(docs, settings=secret_scan.Training(findings=5))
    assert {r[3] for r in drawn} <= {0, 1} and all(sum(r[3] == k for r in drawn) <= 5 for k in (0, 1))
    assert len(drawn) == len(set(drawn))
    # Labelled findings that the forest has not seen.
    forest, held = secret_scan.train(secret_scan.labelled_findings(1500, seed=1)), secret_scan.labelled_findings(500, seed=99)
    points = np.array([secret_scan.features(t, a, b) for t, a, b, _ in held], float)
    hits = forest.probability(points) >= 0.5
    labels = np.array([r[3] for r in held]) == 1
    assert (hits & labels).sum() >= 0.95 * labels.sum() and (hits & ~labels).sum() <= 0.05 * hits.sum()


def test_quality_of_odd_tables(spark):
    good = " ".join(f"word{i} goes on." for i in range(30))
    rows = [(1, good, "d", 1), (1, good, "d", 1), (2, None, "d", 1), (3, "", "d", 1), (4, "too short", "d", 1), (5, good + "\n" + "| » • › " * 3, "d", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, line string, n_words int")
    left = quality.clean(df, "text")
    assert left.columns == df.columns
    kept = left.collect()
    assert sorted(r.doc_id for r in kept) == [1, 1, 5] and all(r.text.startswith("word0 goes") and "»" not in r.text for r in kept)
    assert quality.clean(df.limit(0), "text").count() == 0


@pytest.mark.parametrize("name", ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "bpe_encoding"])
def test_pipeline_stages_take_odd_tables(spark, tmp_path, name):
    spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(15))), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    good = " ".join(f"word{i} goes on." for i in range(30))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, good, "en", "s", len(good)), (1, good, "en", "s", len(good)), (None, good + " more", None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0)]
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(rows, schema)
    out = stage(spark, docs, str(tmp_path))
    if name != "bpe_encoding":
        assert out.columns == docs.columns and dict(out.dtypes)["n_chars"] == "bigint"
    assert {r.text for r in out.collect()} <= {good, good + " more", None, ""} and good[:20] in str(out.collect())
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline_is_its_stages(spark, tmp_path):
    draw = random.Random(12)
    text = lambda n: ". ".join(" ".join(draw.choice(WORDS) + str(draw.randint(0, 99)) for _ in range(8)) for _ in range(n))
    item = " ".join(f"bench{i}" for i in range(14))
    base, secret = text(12), "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    docs = [(1, base), (2, base), (3, base + " tail"), (4, text(12) + " " + item + " " + text(12)), (5, text(9) + f' password = "{secret}" ' + text(9)), (6, "short"), (7, text(10)), (8, None)]
    folder = str(tmp_path / "in")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(found) == {1, 4, 5, 7} and "bench3" not in found[4].text and secret not in found[5].text and found[7].text == docs[6][1]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert all(r.ids == library.encode(r.text, add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in found.values())
