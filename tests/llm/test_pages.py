import random
import re

import numpy as np
import pytest

from siteloom.llm.blocks import GOOD, content_lines
from siteloom.llm.pages import boilerplate_lines, frequent_lines, main_content, page_statistics, prose_models, repeated_site_lines, template_residue, text_quality, without_lines, without_residue
from siteloom.llm.quality import LEAST_SPREAD, STATS, page_stats
from siteloom.llm.residue import body_field, coverage, leaks_variable, short_field

SCHEMA = "page_id long, final_url string, title string, meta_description string, body_text string, word_count int, line_no int, kind string, site string, lang string, n long"


def pages(spark, rows):
    full = [(r["page_id"], r.get("final_url"), r.get("title"), r.get("meta"), r.get("body"), r.get("words"), 7, "clash", "clash", "clash", 1) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


RESIDUE = {
    "{{ product_name }}": "variable", "Why this – {{heading}}": "variable", "undefined | Brand & Co": "variable", "null": "variable", "[object Object] – Brand Labs": "variable", "%%TITLE%%": "variable", "__PAGE_TITLE__": "variable", "<?= $city ?> docs": "variable",
    "Lorem ipsum dolor massa cursus amet": "filler", "Ipsum rutrum fusce ornare tempor": "filler", "Untitled page": "filler", "New page (3)": "filler", "Titel einfügen": "filler",
    "404 Not Found | Brand": "error", "Página no encontrada": "error", "Erreur 404": "error", "Access denied | Brand Ltd": "error", "JavaScript erforderlich": "scripts", "Just a second ...": "scripts",
}
REAL = ["How to repair a 404 Not Found page in 6 steps", "Why Lorem ipsum hurts your launch: audit run", "Template variables and the verbose title tag", "The template writes `{{ name }}` here", "Null results in physics", "100% off", "An undefined behaviour", "Just a moment of peace in the hills", "a {b} and the [link] of 5% x %", ""]


def test_titles():
    assert {k: short_field(k, True) for k in RESIDUE} == RESIDUE
    assert [short_field(k, True) for k in REAL] == [""] * len(REAL)
    assert short_field(None, True) == "" and short_field("  ", False) == ""


def test_bodies():
    nav, foot = "Home / Blog / Contact\n\n", "\nPrivacy\nImprint\n© 2024 Brand"
    prose = "We measured the old sitemap before the release and it held. After 30 checks on 20 pages the index was still complete, so the work was done.\n" * 3
    assert body_field(nav + "Why the log fails\nThis item is no longer here. It may have been deleted by its owner." + foot) == "error"
    assert body_field(nav + "A headline\nPlease turn on scripts and reload the page." + foot) == "scripts"
    assert body_field(nav + prose + "Please turn on scripts and reload the page." + foot) == ""
    assert body_field(nav + prose + "When it is overloaded it sends `503 Service Unavailable`." + foot) == ""
    assert body_field(nav + prose.replace("release", "{{ title }}", 1) + foot) == "variable"
    assert body_field(nav + "A headline\nLorem ipsum dolor sit amet pharetra porta.\nVestibulum donec blandit pretium congue." + foot) == "filler"
    assert body_field(None) == body_field("") == body_field(" \n \r\n") == ""
    assert body_field("x" * 300_000) == ""
    assert not leaks_variable(".a-3{margin:3px;color:#fff}") and coverage("")[0] == 0.0


def test_residue_table(spark):
    rows = [{"page_id": 1, "title": "Untitled page", "meta": "{{x}}", "body": None}, {"page_id": 2}, {"page_id": 3, "title": "A fine title of a page", "body": ""}, {"page_id": 1, "title": "Untitled page"}]
    df = pages(spark, rows)
    assert sorted((r.page_id, r.field_name, r.kind) for r in template_residue(df).collect()) == [(1, "meta_description", "variable"), (1, "title", "filler"), (1, "title", "filler")]
    assert [r.page_id for r in without_residue(df).orderBy("page_id").collect()] == [2, 3]
    assert template_residue(pages(spark, [])).count() == 0


def brute_repeated(rows, least=5, of=5):
    form = lambda x: re.sub("[0-9]+", "#", " ".join(x.split()).lower())
    site = lambda u: (re.match(r"[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", (u or "").lower()) or [None, None])[1]
    count, total = {}, {}
    for r in rows:
        if r.get("body") is None or not site(r.get("final_url")):
            continue
        total[site(r["final_url"])] = total.get(site(r["final_url"]), 0) + 1
        for f in {form(x) for x in r["body"].split("\n")} - {""}:
            count[site(r["final_url"]), f] = count.get((site(r["final_url"]), f), 0) + 1
    return {(r["page_id"], i) for r in rows if r.get("body") is not None and (s := site(r.get("final_url"))) for i, x in enumerate(r["body"].split("\n")) if (f := form(x)) and count[s, f] >= least and count[s, f] * of >= total[s]}


def test_repeated_lines(spark):
    rng = random.Random(3)
    lines = ["Footer 2023", "footer  2024 \r", "Share this", "", "  ", "Ünï Cödé 5", "A B", "only here"]
    rows = [{"page_id": i, "final_url": rng.choice(["https://hot.example/a", "HTTPS://Hot.Example:443/b", "http://u@hot.example?x", "https://small.example/", "no url", None, ""]), "body": rng.choice([None, "", "\n".join(rng.choices(lines, k=rng.randrange(1, 7)) + [f"text {chr(97 + i % 26)}{'x' * i}"])])} for i in range(90)]
    df = pages(spark, rows).repartition(5)
    expected = brute_repeated(rows)
    assert expected and {(r.page_id, r.line_no) for r in repeated_site_lines(df).collect()} == expected
    clean = {r.page_id: r.clean_text for r in without_lines(df, repeated_site_lines(df)).collect()}
    for r in rows:
        assert clean[r["page_id"]] == (None if r["body"] is None else "\n".join(x for i, x in enumerate(r["body"].split("\n")) if (r["page_id"], i) not in expected))
    assert repeated_site_lines(pages(spark, [])).count() == 0 and frequent_lines(pages(spark, rows[:3])).count() == 0


def test_main_content():
    body = "Home / Blog / Contact\nBlog > News > a title of it\n13 notes on the old index page\nBy Wren Brandelow\nPublished 12 June 2026\n\nThe index page was slow, but the cache helped it. It took 4 hours until it was done.\nIn short\nAnother fine sentence stands here for the reader.\r\nSee also → 13 notes on it\nTags: a, b\nShare this page (13)\nRelated articles\nHow another crawl ends\n- Why it begins\n\nSubscribe to our newsletter\nPrivacy • Imprint • Sitemap\n© 2024 Brand"
    lines, labels = content_lines(body)
    assert [x for x, label in zip(lines, labels) if label == GOOD] == ["13 notes on the old index page", "The index page was slow, but the cache helped it. It took 4 hours until it was done.", "In short", "Another fine sentence stands here for the reader."]
    assert content_lines(None) == ([], []) and content_lines("")[1] == [-1]


def test_content_tables(spark):
    rows = [{"page_id": 1, "body": "Home\n\nA sentence that says something of use to you."}, {"page_id": 2}, {"page_id": 3, "body": ""}, {"page_id": 4, "body": "word " * 60_000}]
    assert [(r.page_id, r.line_no) for r in boilerplate_lines(pages(spark, rows)).collect()] == [(1, 0)]
    assert {r.page_id: r.main_text for r in main_content(pages(spark, rows[:3])).collect()} == {1: "A sentence that says something of use to you.", 2: None, 3: ""}
    assert boilerplate_lines(pages(spark, [])).count() == 0


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    nouns = "page crawl index sitemap report heading cluster editor monitor snapshot header".split()
    rows = []
    for i in range(300):
        text = "\n".join(" ".join(f"The {rng.choice(nouns)} of the {rng.choice(nouns)} was checked and it held for {rng.randrange(2, 90)} days." for _ in range(rng.randrange(2, 6))) for _ in range(rng.randrange(3, 9)))
        rows.append({"page_id": i, "body": text, "words": len(text.split()) + (i % 10 == 0)})
    rows += [
        {"page_id": 1000, "body": "\n".join(f"- the {rng.choice(nouns)} of a {rng.choice(nouns)}" for _ in range(25)), "words": None},
        {"page_id": 1001, "body": "\n".join(f"/{rng.choice(nouns)}-{k}\t{k}\t20{k}" for k in range(25)), "words": 75},
        {"page_id": 1002, "body": "\n".join("!function(e,w){var m=%d;for(;j<75;)e[46]=t.y&&r(1409)}(this);" % k for k in range(20)), "words": 40},
        {"page_id": 1003, "body": None, "words": 0}, {"page_id": 1004, "body": "  \n", "words": 3}, {"page_id": 1005, "body": None, "words": 4},
    ]
    return rows


def test_quality(spark, corpus):
    got = {r.page_id: r for r in text_quality(pages(spark, corpus)).collect()}
    assert len(got) == len(corpus)
    assert [got[i].verdict for i in range(1000, 1006)] == ["list", "table", "junk", "empty", "empty", "empty"]
    assert {got[i].verdict for i in range(300)} == {"prose"}
    assert {i for i, r in got.items() if r.wrong_count} == {i for i in range(0, 300, 10)} | {1004, 1005}
    for i in (0, 7, 1000, 1002):
        assert got[i].distance == pytest.approx(sum(got[i][f"from_{s}"] for s in STATS))


def test_models_match_numpy(spark, corpus):
    from siteloom.llm.pages import FAR, ROUNDS

    stats = page_statistics(pages(spark, corpus))
    x = np.array([[r[s] for s in STATS] for r in stats.where("lang != ''").collect()])
    med = np.median(x, axis=0)
    mad = np.maximum(LEAST_SPREAD, 1.4826 * np.median(abs(x - med), axis=0))
    near = (abs(x - med) <= 3 * mad).all(axis=1)
    for k in range(ROUNDS):
        mean, cov = x[near].mean(axis=0), np.cov(x[near].T, bias=True) + np.diag(np.square(LEAST_SPREAD))
        near = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean) <= FAR
    models = {k: (m, c) for k, m, c in prose_models(stats)[0]}
    assert np.allclose(models["en"][0], mean, atol=1e-3) and np.allclose(models["en"][1], cov, atol=1e-3)


def test_distance_decides(spark, corpus):
    near = {r.page_id: r.verdict for r in text_quality(pages(spark, corpus), far=1e12).collect()}
    assert {near[i] for i in range(1000, 1003)} == {"prose"}


def test_quality_of_nothing(spark):
    assert text_quality(pages(spark, [])).count() == 0
    assert [r.verdict for r in text_quality(pages(spark, [{"page_id": 1}, {"page_id": 2, "body": "¿¿¿"}])).orderBy("page_id").collect()][0] == "empty"
    assert page_stats([], [])[1] == [0.0] * len(STATS)


def test_boilerplate_of_held_out_sites(spark):
    from heldout import site_pages

    rows, truth = site_pages()
    bad = {k for k, v in truth.items() if v}
    assert len({r["body"].split("\n")[i] for r, i in ((rows[p], i) for p, i in truth)}) > 200
    got = {(r.page_id, r.line_no) for r in boilerplate_lines(pages(spark, rows)).collect()}
    assert len(got & bad) >= 0.9 * len(bad) and len(got & bad) >= 0.9 * len(got)
    # sites of three pages
    rows3, truth3 = site_pages(3, seed=5)
    bad3 = {k for k, v in truth3.items() if v}
    got3 = {(r.page_id, r.line_no) for r in boilerplate_lines(pages(spark, rows3)).collect()}
    assert len(got3 & bad3) >= 0.9 * len(bad3) and len(got3 & bad3) >= 0.9 * len(got3)
    # a page on its own, with neighbours alone
    alone = {(p, i) for p, r in enumerate(rows) for i, label in enumerate(content_lines(r["body"], r["title"])[1]) if label == 0}
    assert len(alone & bad) >= 0.35 * len(bad) and len(alone & bad) >= 0.9 * len(alone)


def test_long_lines_get_the_same_rules():
    prose = "The path climbs away from the quarry and it was built beside the mill in the year of the flood.\n" * 3
    menu = " | ".join(f"Label{chr(97 + i % 26)}" for i in range(80))
    notice = "We keep cookies on your device so that you stay signed in, and we and our partners measure how this site is used, which you may refuse at any time. " * 2
    lines, labels = content_lines(f"{notice}\n{menu}\n\n{prose}\n{menu}", "A page")
    assert labels[0] == labels[1] == labels[-1] == 0 and labels[3] == 1


def test_undecided_lines_inherit():
    prose = "The path climbs away from the quarry and it was built beside the mill in the year of the flood, as every guide of the valley says."
    names = "Zorvel\nKlimbat\nPrastuk\nDelmor"
    lines, labels = content_lines(f"{names}\n\n{prose}\n{prose}\n\n{names}\n© 2020 Zorvel")
    assert labels[:4] == [0] * 4 and labels[-5:] == [0] * 5 and labels[5:7] == [1, 1]
    lines, labels = content_lines(f"{prose}\n{names}\n{prose}")
    assert labels == [1] * 6


def test_hot_site_and_missing_hosts(spark):
    rows = [{"page_id": i, "final_url": "https://hot.test/%d" % i if i % 3 else None, "body": f"Zorvel\nThe text of page {'x' * i} is here and it is not the same as any other one of them all.\nEnd mark"} for i in range(60)]
    got = {(r.page_id, r.line_no) for r in boilerplate_lines(pages(spark, rows)).collect()}
    assert {p for p, i in got if i == 2} >= {i for i in range(60) if i % 3} and not any(i == 1 for _, i in got)


def test_residue_of_held_out_messages():
    from heldout import CONTENT, MESSAGES

    said = [(kind, m) for kind, ms in MESSAGES.items() for m in ms]
    right = sum(short_field(m, False) == kind for kind, m in said)
    assert right >= 0.9 * len(said)
    assert sum(short_field(m, True) != "" for m in CONTENT) <= 0.05 * len(CONTENT)
    nav, foot = "Trails | Huts | Maps | Weather\n\nA heading\n", "\n© 2024 Fellhiker"
    assert sum(body_field(nav + m + foot) == kind for kind, m in said if len(m.split()) >= 4) >= 0.9 * sum(len(m.split()) >= 4 for _, m in said)
