"""Decontamination, personal data, fingerprints, pages, scores and languages."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, html_template, language_ecoc, multiset_fingerprint, pii_surrogates, quality_pu

from .conftest import prose


def words_of(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute_hits(docs, items, n=10):
    wins = {}
    for i, t in items:
        w = words_of(t)
        k = min(n, len(w))
        for s in range(len(w) - k + 1) if k else ():
            wins.setdefault(tuple(w[s : s + k]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, who = words_of(t), set(), set()
        for k in {len(x) for x in wins}:
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in wins:
                    hit |= set(range(s, s + k))
                    who |= wins[tuple(w[s : s + k])]
        out[d] = (len(w), len(hit), sorted(who))
    return out


def test_windows_are_found_exactly(spark):
    a, b = prose(1, 14), prose(2, 25)
    items = [(10, a), (9, b), (11, "Ab, cd"), (12, "solo"), (13, None), (14, "--"), (15, "the the the the the the the the the the the the")]
    docs = [(1, prose(3, 30) + " " + a.upper() + ". " + prose(4, 5)), (2, b[: len(b) // 2]), (3, "x ab-cd y"), (4, "nothing here"), (5, None), (6, "the " * 40), (7, "Solo É " + b), (8, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    b_ = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contaminated(d, b_).collect()}
    assert got == brute_hits(docs, items)
    far = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contaminated(d, b_, broadcast_rows=0).collect()}
    assert far == got


def test_decontamination_of_odd_rows(spark, odd_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.contaminated(odd_docs, none).collect()
    assert len(rows) == odd_docs.count() and all(r["n_hit"] == 0 for r in rows)
    assert decontaminate.contaminated(odd_docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_surrogates(spark):
    docs = [
        (1, "Mail Ann.Lee@Site.org or ann.lee@site.org, call +1 (743) 555-3824."),
        (2, "again ann.lee@site.org and 10.1.2.3; card 4785380592391139; token = \"f33e61083db5dbdf4bd2369d2f80176e57f7fda2\""),
        (3, "Frau Maria Schmidt, Mr. Tom Hill, иван@почта.рф, 123-45-6789, GB82 WEST 1234 5698 7654 32"),
        (4, "clean: version 1.2.3, 2024-01-01, 12:30, 3.14, 100,000"),
    ]
    out = {r["doc_id"]: r for r in pii_surrogates.pseudonymized(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for secret in ("ann.lee", "Ann.Lee", "555-3824", "10.1.2.3", "4785380592391139", "f33e6108", "Schmidt", "Hill", "иван", "123-45-6789", "5698"):
        assert all(secret not in r["text"] for r in out.values())
    mail = re.search(r"[a-z]+@example\.net", out[2]["text"])[0]
    assert out[1]["text"].count(mail) == 2  # one person, whatever the case
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}\.$", out[1]["text"])
    assert re.search(r"card 4\d{15};", out[2]["text"]) and re.search(r'token = "[0-9a-f]{40}"', out[2]["text"])
    assert re.search(r"Frau \w+na \w+, Mr\. \w+n \w+, [а-я]+@example\.net, \d{3}-\d{2}-\d{4}, GB\d\d WEST", out[3]["text"])
    assert out[4]["text"] == docs[3][1] and out[4]["pii_kinds"] == []
    assert out[2]["pii_kinds"] == ["account", "email", "ip", "secret"]


def test_names_keep_gender_and_script(spark):
    docs = [(1, "Mrs. Ali Hassan met Mr. Ali Hassan, Mrs Jones, Mr Jones and Dr. Jane Roe."), (2, "Mr. 王小明 and Mr. דוד; call +15551234567 or +442079460958"), (3, "token_abc=\"f33e61083db5\" secret: " + "a1" * 200)]
    out = {r["doc_id"]: r["text"] for r in pii_surrogates.pseudonymized(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert re.search(r"Mrs\. \w+na \w+ met Mr\. \w+[^a] \w+, Mrs \w+na, Mr \w+n and Dr\. \w+ \w+\.$", out[1]) and "Hassan" not in out[1] and "Roe" not in out[1]
    assert re.search(r"Mr\. [\u4e00-\u9fff]+ and Mr\. [\u05d0-\u05ea]+; call \+1\d{10} or \+44\d{10}$", out[2]) and "王" not in out[2]
    assert "f33e61083db5" not in out[3] and re.search(r"secret: [0-9a-f]{400}$", out[3])
    none = pii_surrogates.pseudonymized(spark.createDataFrame([], "doc_id long, text string, pii_kinds int"))
    assert none.columns == ["doc_id", "text", "pii_kinds"] and none.count() == 0


def test_number_surrogates_equal_a_plain_feistel(spark):
    """The permutation of digits is one-to-one on its domain."""
    docs = [(0, " ".join(f"{i:03d}-{i % 97:02d}-{i * 7 % 10000:04d}" for i in range(1000)))]
    e = pii_surrogates.entities(spark.createDataFrame(docs, "doc_id long, text string")).toPandas()
    assert set(e.kind) == {"ssn"} and e["sub"].nunique() == len(e) == 1000 and e["sub"].str.fullmatch(r"\d{3}-\d{2}-\d{4}").all()


def test_surrogates_stay_apart(spark):
    docs = [(i, f"ip 10.0.{i // 200}.{i % 200 + 1} tel +1 (200) 555-{i:04d} id {4000000000000000 + i}") for i in range(1500)]
    e = pii_surrogates.entities(spark.createDataFrame(docs, "doc_id long, text string")).toPandas()
    assert len(e) == 4500 and e["sub"].nunique() == 4500 and not set(e["raw"]) & set(e["sub"])


def test_numbers_of_a_whole_domain(spark):
    """All 10,000 numbers of one shape: a permutation without a fixed point, so every salt will do at any size."""
    docs = [(i, f"+49 {i // 100:02d} {i % 100:02d}") for i in range(10_000)]
    e = pii_surrogates.entities(spark.createDataFrame(docs, "doc_id long, text string")).toPandas()
    assert len(e) == 10_000 and set(e["raw"]) == set(e["sub"]) and not (e["raw"] == e["sub"]).any()
    assert pii_surrogates.safe_salt(spark.createDataFrame(docs, "doc_id long, text string")) == 0


def test_account_numbers_keep_their_checks(spark):
    def mod97(iban):
        s = iban.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97

    right = ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "FR1420041010050500013M02606"]
    wrong = ["GB83 WEST 1234 5698 7654 32", "DE00370400440532013000"]
    docs = [(i, t) for i, t in enumerate([*right, *wrong, "GB82WEST12345698765432", "AB12 ABCD EFGH IJKL"])]
    out = {r["raw"]: r["sub"] for r in pii_surrogates.entities(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(out) == len(docs) and len({s.replace(" ", "") for s in out.values()}) == len(docs) - 1
    assert all(mod97(r) == 1 == mod97(out[r]) for r in right) and all(mod97(out[r]) != 1 for r in wrong)
    assert out["GB82WEST12345698765432"] == out[right[0]].replace(" ", "")
    assert all(re.sub(r"\d", "0", r) == re.sub(r"\d", "0", s) and r != s for r, s in out.items())


def test_mail_keeps_its_shape(spark):
    docs = [(1, "ann.lee-77@site.org"), (2, "........@b.co"), (3, "a@b.co"), (4, "b@b.co"), (5, "ИВАН.П@ПОЧТА.РФ"), (6, "x" * 200 + ".1@y.org")]
    out = {r["raw"]: r["sub"] for r in pii_surrogates.entities(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(set(out.values())) == 6 and all(s.lower().endswith("@example.net") for s in out.values())
    assert re.match(r"[a-z]{3}\.[a-z]{3}-\d\d[a-z]{16}@", out["ann.lee-77@site.org"]) and re.match(r"[А-Я]{4}\.[А-Я]{20}@", out["ИВАН.П@ПОЧТА.РФ"])
    assert re.match(r"[a-z]{200}\.\d@", out["x" * 200 + ".1@y.org"])


def test_no_salt_that_meets_an_original(spark):
    """A hashed surrogate that is another entity's original moves the salt on."""
    one = spark.createDataFrame([(1, "ann@site.org")], "doc_id long, text string")
    met = pii_surrogates.entities(one).first()["sub"]
    assert pii_surrogates.safe_salt(one) == 0
    assert pii_surrogates.safe_salt(one.union(spark.createDataFrame([(2, met)], "doc_id long, text string"))) == 1


def test_pii_odd_rows(odd_docs):
    out = pii_surrogates.pseudonymized(odd_docs)
    assert out.columns == [*odd_docs.columns, "pii_kinds"] and out.count() == odd_docs.count()
    same = out.join(odd_docs.withColumnRenamed("text", "before").select("doc_id", "before"), "doc_id")
    assert same.where("not text <=> before").count() == 0


def test_fingerprints(spark):
    docs = [(i * 7, prose(i, 40) + "\n" + prose(i + 9, 30)) for i in range(23)] + [(500, None), (501, ""), (502, "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for size in (5, 1000):
        got = {r["doc_id"]: r for r in multiset_fingerprint.fingerprints_with_next(df, rows_per_bucket=size).collect()}
        assert len(got) == len(docs)
        for k, (i, t) in enumerate(docs):
            t, n = t or "", docs[(k + 1) % len(docs)][1] or ""
            q = len(t) // 4
            e = t[: len(t) - q] + n[:q]
            fp = multiset_fingerprint.fingerprint
            assert got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and got[i]["n_chars"] == len(t)
            assert got[i]["fingerprint"] == fp(t).hex() and got[i]["edited_fingerprint"] == fp(e).hex()
            assert got[i]["near_next"] == multiset_fingerprint.likeness(fp(t), fp(n))
    long = [r for r in got.values() if r["n_chars"] > 200]
    assert np.mean([r["near_edited"] for r in long]) > 0.6 and np.mean([r["near_next"] for r in long]) < 0.1


def test_fingerprint_is_a_multiset_hash():
    fp, add = multiset_fingerprint.fingerprint, multiset_fingerprint.paragraphs_sum
    assert fp("a b c d\ne f g\nh").hex() == fp("h\na b c d\ne f g").hex() != fp("h\na b c d\ne f g\nh").hex()
    assert (fp("x y z\nq") + add(["w w w"])).hex() == fp("x y z\nw w w\nq").hex()
    assert (fp("x y z\nw w w\nq") - add(["w w w"])).hex() == fp("x y z\nq").hex()


def test_fingerprints_of_odd_rows(odd_docs):
    assert multiset_fingerprint.fingerprints_with_next(odd_docs).count() == odd_docs.count()
    assert multiset_fingerprint.fingerprints_with_next(odd_docs.limit(0)).count() == 0
    one = multiset_fingerprint.fingerprints_with_next(odd_docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><article>";</script></head><body class="with-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- <article>no</article> -->
<article><header><h1>{0}</h1><p>by someone</p></header><p>A{1} &amp;lt; B &copy;<br>c{1}&nbsp;d <b>bo<i>ld</b></i><p>Plain{1}&#8364;
<div class="ad-slot">Buy</div><form><input> Search</form><aside>Side</aside><p>{2}</p><section id="comments"><article class="comment">bad</article></section></article>
<p>Read our terms</p><footer>Foot</footer></body></html>"""


def test_main_text(spark):
    pages = [(i, f"https://a.org/{i}", PAGE.format(f"Title {i}", i, prose(i, 20))) for i in range(8)] + [(90, None, None), (91, "x", ""), (92, "https://b.org/", "loose <b>te</b>xt<script>no"), (93, "https://b.org/2", "<p>one<p>two</div><li>three")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in html_template.main_text(df).collect()}
    for i in range(8):
        assert got[i] == f"Title {i} A{i} &lt; B © c{i} d bold Plain{i}€ {prose(i, 20)}"
    assert got[90] == got[91] == "" and got[92] == "loose text" and got[93] == "one two three"
    assert html_template.main_text(df.limit(0)).count() == 0


def test_classes_without_any_names(spark, monkeypatch):
    """With all word lists emptied, classes still tell the article from what most pages share."""
    for name in ("NOT_TEXT", "NAMES", "ROLES"):
        monkeypatch.setattr(html_template, name, frozenset())
    page = "<body><div class=top>Home of the news</div><div class=a>{0}</div><div class=b>{1}</div>{3}<ul class=l><li><a href=1>{2} a link with many words</a></ul><div class=end>All rights</div></body>"
    pages = [(i, "http://h.net/p", page.format(prose(i, 30), prose(i + 40, 20), prose(i + 80, 2), "<div class=n>Buy now</div>" * (i % 2 + 1) if i else "")) for i in range(12)]
    pages += [(50 + i, "http://h.net/e", "") for i in range(9)]
    got = {r["page_id"]: r["text"] for r in html_template.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == prose(i, 30) + " " + prose(i + 40, 20) for i in range(12)) and got[50] == ""


def test_pages_without_an_article_on_a_host_with_articles(spark):
    pages = [(i, "http://h.net/p", f"<article>{prose(i, 30)}</article>") for i in range(6)]
    pages += [(20 + i, "http://h.net/q", f"<body><div class=x>{prose(i + 30, 40)}</div><div class=y>{prose(i + 60, 3)}</div></body>") for i in range(6)]
    pages += [(40, None, "<p>" + "long " * 50_000)] * 2
    got = {r["page_id"]: r["text"] for r in html_template.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == prose(i, 30) and got[20 + i] == prose(i + 30, 40) for i in range(6)) and len(got[40]) == 249_999


def test_template_text_is_dropped(spark):
    page = "<body><div class=m1><a href=1>{1}</a> <a href=2>more links here</a></div><div class=c>{0}<p>The same notice on every page.</p></div></body>"
    pages = [(i, "http://h.net/p", page.format(prose(i, 30), prose(i + 40, 2))) for i in range(9)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_template.main_text(df).collect()}
    assert all(got[i] == prose(i, 30) for i in range(9))
    assert all(r["text"].endswith("every page.") for r in html_template.main_text(df.limit(2)).collect())  # two pages are no template


def test_quality_learns_junk(spark):
    good = [(i, prose(i, 60)) for i in range(300)]
    junk = [(1000 + i, prose(i, 60).upper().replace(" ", "!! ")) for i in range(100)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string").withColumn("quality", F.lit(3))
    labels = spark.createDataFrame([(i, 1) for i in range(200)] + [(1000 + i, 0) for i in range(50)], "doc_id long, quality int")
    out = quality_pu.quality_scores(docs, labels).toPandas()
    assert (out[out.doc_id < 1000].score >= 0.7).mean() > 0.97 and (out[out.doc_id >= 1000].score < 0.7).all()


def test_quality_of_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (5, 1), (9, 0), (None, 1), (6, None)], "doc_id long, quality int")
    rows = quality_pu.quality_scores(odd_docs.drop("score"), labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_pu.quality_scores(odd_docs.limit(0).drop("score"), labels).count() == 0


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(0)
    p, u = rng.normal(2, 1, 4000), np.r_[rng.normal(2, 1, 2800), rng.normal(-2, 1, 1200)]
    assert abs(quality_pu.best_bin_prior(p, u) - 0.7) < 0.06


def test_codewords_are_apart():
    for n in (2, 4, 7, 20):
        c = language_ecoc.codewords(n)
        assert len({tuple(r) for r in c.tolist()}) == n
        if n > 2:
            assert min((a != b).sum() for i, a in enumerate(c) for b in c[:i]) >= 2


def test_languages(spark, odd_docs):
    rows = []
    for k, (lang, tail) in enumerate((("aa", "tion"), ("bb", "schung"), ("cc", "ción"))):
        rows += [(k * 1000 + i, " ".join(w + tail for w in prose(k * 1000 + i, 30).split()), lang) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_ecoc.fit(docs, ~language_ecoc.held_out())
    out = language_ecoc.identified(docs, model).where(language_ecoc.held_out()).toPandas()
    assert (out.lang == out.lang_pred).all() and len(out) > 15
    odd = {r["doc_id"]: r for r in language_ecoc.identified(odd_docs, model).collect()}
    assert [odd[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and odd[2]["lang_score"] == 0 and odd[8]["lang_pred"] in ("aa", "bb", "cc")
    empty = language_ecoc.fit(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language_ecoc.identified(odd_docs, empty).collect()} == {"und"}
    assert language_ecoc.identified(odd_docs.limit(0), model).count() == 0


def test_only_ordered_and_nested_classes_are_template(spark):
    """Lines that change places on a host's pages are text; a line in its place on each of them is not."""
    lines = [prose(500 + i, 6) for i in range(3)]
    pages, want = [], {}
    for i in range(12):
        own = lines[i % 3 :] + lines[: i % 3]
        want[i] = " ".join([prose(i, 20), *own[:: 1 if i % 2 else -1]])
        body = "".join(f"<p>{x}</p>" for x in own[:: 1 if i % 2 else -1])
        pages.append((i, "http://h.net/p", f"<article><p>Read this first.</p><p>{prose(i, 20)}</p>{body}<p>The end of it.</p></article>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_template.main_text(df).collect()} == want
    assert {r["page_id"]: r["text"] for r in html_template.main_text(df, broadcast_rows=0).collect()} == want


def test_classes_that_cross_are_not_nested():
    def pairs(line):
        at = {t: [i for i, x in enumerate(line) if x == t] for t in line}
        return [(x, y, html_template.pattern(at[x], at[y]), 10) for x in sorted(at) for y in sorted(at) if x < y]

    big, small = (10, [1, 2]), (9, [3, 4])
    assert html_template.valid_tokens([big, small], pairs([1, 3, 4, 2]), 0.9) == [1, 2, 3, 4]
    assert html_template.valid_tokens([big, small], pairs([3, 1, 2, 4]), 0.9) == [1, 2, 3, 4]
    assert html_template.valid_tokens([big, small], pairs([1, 3, 2, 4]), 0.9) == [1, 2]
    assert html_template.valid_tokens([(10, [1]), (9, [2])], [(1, 2, 1, 5), (1, 2, -1, 4)], 0.9) == [1]
