"""Language identification, HTML, personal data and chat formatting."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from colmap.llm import chat, html, langid, pii
from tests.conftest import SMALL

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


# ---- language identification

def bucket(docs):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs, bucket(docs) != 1)
    assert len(model.languages) == 4 * len(set(model.languages))
    got = docs.where(bucket(docs) == 1).select(
        "lang", langid.predict(F.col("text"), model).alias("p")).select("lang", "p.*").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in got)
    assert right / len(got) > 0.98
    assert sum(r["rejected"] for r in got) / len(got) < 0.01
    assert all(0 <= r["score"] <= 1 for r in got)


def test_pieces_do_not_change_counts(monkeypatch):
    text = "Größe und  Ähnliches, 12 mots d'été — " * 30
    whole, n = langid.gram_counts(text)
    for size in (1, 2, 7, 100):
        monkeypatch.setattr(langid, "PIECE", size)
        got, m = langid.gram_counts(text)
        assert m == n and (got == whole).all()


def test_language_edges(spark, edges, no_docs):
    model = langid.fit(edges, F.col("doc_id").isNotNull())
    got = edges.select("doc_id", langid.predict(F.col("text"), model).alias("p")).select(
        "doc_id", "p.*").collect()
    assert len(got) == edges.count()
    for r in got:
        if r["doc_id"] in (3, 4, 5, 9):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        else:
            assert r["lang_pred"] in ("de", "en")
    nothing = langid.fit(no_docs, F.lit(True))
    got = edges.select(langid.predict(F.col("text"), nothing).alias("p")).select("p.*").collect()
    assert {r["lang_pred"] for r in got} == {"und"}
    assert no_docs.select(langid.predict(F.col("text"), model)).count() == 0


POLISH = ("W małym miasteczku nad rzeką mieszkał stary zegarmistrz, który codziennie otwierał "
          "swój warsztat przed świtem i naprawiał zegary całej okolicy. ")
FINNISH = ("Pienessä kaupungissa joen varrella asui vanha kelloseppä, joka avasi pajansa joka "
           "aamu ennen auringonnousua ja korjasi koko seudun kellot. ")
TURKISH = ("Nehir kıyısındaki küçük kasabada yaşlı bir saatçi yaşardı, her sabah dükkânını açar "
           "ve bütün çevrenin saatlerini onarırdı. ")


def test_latin_junk_and_unlearned_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs, bucket(docs) != 1)
    rnd = random.Random(3)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    odd = []
    for n in (100, 200, 500, 1000, 3000):
        odd += [(f"{name} {n}", (text * 50)[:n]) for name, text in (
            ("pl", POLISH), ("fi", FINNISH), ("tr", TURKISH))]
        odd += [(f"base64 {n}", "".join(rnd.choices(base64, k=n))),
                (f"letters {n}", "".join(rnd.choices(base64[26:52] + " ", k=n)))]
    found = spark.createDataFrame(odd, "name string, text string").select(
        "name", langid.predict(F.col("text"), model).alias("p")).select("name", "p.*").collect()
    assert [r["name"] for r in found if not r["rejected"]] == []
    clean = docs.where((bucket(docs) == 1) & (F.length("text") > 0)).select(
        langid.predict(F.col("text"), model)["rejected"].alias("r")).collect()
    assert sum(r["r"] for r in clean) <= 0.005 * len(clean)


def test_unlike_texts_are_rejected(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.fit(docs, F.lit(True))
    odd = spark.createDataFrame([("漢字仮名交じり文の例です。" * 20,), ("жзхц щъыь эюя " * 20,)], "text string")
    assert all(r[0]["rejected"] for r in odd.select(
        langid.predict(F.col("text"), model).alias("p")).collect())


# ---- HTML

PAGES = [
    (None, ""), ("", ""), ("just text", "just text"),
    ("<article><p>a &lt;b&gt; &#233;&eacute;<p>c\n\t d</article>", "a <b> éé\nc d"),
    ("<nav><a href=/>Home</a></nav><main><h1>T</h1><div>x<br>y</div></main><footer>f</footer>",
     "T\nx y"),
    ('<article>keep<div class="ad-box">buy</div><form>in <b>put</form><script>"</p>"</script>'
     '<p hidden>no</p><section id="comments"><p>I say</p></section></article>', "keep"),
    ("<article><p>unclosed <b>bold<p>next <a href='x>y'>z</a> and more words", None),
    ("<body><div class='sidebar'>s</div><div class='post has-sidebar'><h1>Title</h1><p>"
     + "the cat and the dog of the house " * 10 + "</p><p>end</p></div></body>", None),
    ("< not a tag <3 <article>fine</article>", "fine"),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_main_text(page, want):
    got = html.main_text(page)
    if want is not None:
        assert got == want
    elif "unclosed" in page:
        assert got == "unclosed bold\nnext z and more words"
    else:
        assert got.split("\n")[0] == "Title" and got.endswith("end") and "s\n" not in got[:2]


def test_rules_without_article():
    good = "<p>" + "it is the story of a man that was in the house and of his dog " * 5 + "</p>"
    links = "<p>" + "<a href=x>one link</a> " * 20 + "</p>"
    page = f"<body>{links}<p>odd</p>{good}<p>Short.</p>{good}{links}<p>Tail</p></body>"
    got = html.main_text(page).split("\n")
    assert len(got) == 4 and got[0] == "odd" and got[2] == "Short."


FOREIGN = {
    "pl": "W małym miasteczku nad rzeką mieszkał stary zegarmistrz, który codziennie otwierał "
          "swój warsztat przed świtem i naprawiał zegary całej okolicy. ",
    "ru": "В маленьком городке у реки жил старый часовщик, который каждое утро открывал свою "
          "мастерскую и чинил часы всей округи. ",
    "tr": "Nehir kıyısındaki küçük kasabada yaşlı bir saatçi yaşardı, her sabah dükkânını açar "
          "ve bütün çevrenin saatlerini onarırdı. ",
    "zh": "河边的小镇上住着一位老钟表匠，他每天清晨打开作坊，为附近所有的人修理钟表。" * 3,
}


@pytest.mark.parametrize("lang", FOREIGN)
def test_pages_in_languages_without_stop_words(lang):
    """No article, no main element: length and links decide."""
    text = FOREIGN[lang].strip()
    links = "<div>" + "<a href=x>link one</a> " * 20 + "</div>"
    page = (f"<body>{links}<div><h1>Tytuł</h1><p>{text}</p><p>Tak.</p><p>{text}</p></div>"
            f"{links}<div>© 2020</div></body>")
    got = html.main_text(page).split("\n")
    assert got[-3:] == [text, "Tak.", text] and not any("link" in b or "©" in b for b in got)


def test_hostile_pages_take_linear_time():
    for page in ("<a " * 100_000, '<a b="' * 100_000, "<p>" * 100_000, "<b>x" * 100_000,
                 "<div>" * 20_000 + "x", "<!--" * 100_000, "&amp" * 100_000):
        html.main_text(page)


def test_pages_of_the_tables(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = html.extract(pages).collect()
    assert len(got) == pages.count()
    assert all(r["n_chars"] == len(r["text"]) > 0 and "©" not in r["text"] for r in got)
    empty = html.extract(pages.limit(0))
    assert empty.columns == ["page_id", "url", "text", "n_chars"] and empty.count() == 0


# ---- personal data

def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    found = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split("."))
                    if kind == "ip" else False,
                    "card": 13 <= len(digits) <= 19 and luhn(digits),
                    "phone": 9 <= len(digits) <= 15}[kind]:
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(found)


def check_pii(df, texts):
    """Every row's base spans, by the digest; rows are told apart by doc_id."""
    got = {r["doc_id"]: r for r in pii.digest(pii.spans(df)).collect()}
    for i, text in texts:
        want = base_spans(text)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (text, got[i])
        assert set(want.split(",")) <= set(got[i]["spans"].split(",")) | {""}


def test_base_entities(spark):
    rnd = random.Random(4)
    parts = ["a@b.c", "_d@e-f.g.h", "x@y", "@", "1.2.3.4", "256.1.1.1", "0001.02.3.4.5.6.7.8",
             "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123.456-78", "+1 2", "+",
             "é", "𝒳", " ", "\n", ".", "-", "5500005555555559", "12", "tel", "00", "+441234567890x"]
    texts = [(i, "".join(rnd.choices(parts, k=rnd.randint(0, 14)))) for i in range(400)]
    texts += [(1000, "9" * 4_000), (1001, "a" * 4_000 + "@"), (1002, "1.1.1.1 " * 3_000),
              (1003, None), (1004, ""), (1005, "a.b" * 1_500 + "@c.d"), (1006, "+1 " * 50_000)]
    check_pii(spark.createDataFrame(texts, "doc_id long, text string"), texts)


def test_pii_edges(spark, edges, no_docs):
    got = pii.digest(pii.spans(edges)).collect()
    assert len(got) == edges.count()
    assert [r["spans"] for r in got if r["doc_id"] is None] == ["email:23:36"]
    assert pii.digest(pii.spans(no_docs)).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    """A cue that only ever stands before phone numbers finds one of another form."""
    cue = "ruf bitte an unter "
    rows = [(i, f"hallo du {cue}+49 30 123456{i} danke") for i in range(20)]
    rows += [(30, f"{cue}(030) nix und {cue}030-987654. ende"), (31, "an unter uns 030-111111"),
             (32, "zahl 030-222222 hier")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.digest(pii.spans(df)).collect()}
    text = dict(rows)[30]
    at = text.index("030-987654")
    assert got[30]["spans"] == f"phone:{at}:{at + 10}" and got[30]["n_discovered"] == 1
    assert got[30]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[31]["spans"] == got[32]["spans"] == ""


def discovered_spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.digest(pii.spans(df)).collect()}
    return [found[i] for i in range(len(texts))]


def test_three_seeds_make_a_context(spark):
    texts = [f"kunde ruf unter +49 30 123456{i} an" for i in range(3)] + ["nun ruf unter 030-987654 an"]
    texts = texts[:3] * 4 + texts[3:]
    assert discovered_spans(spark, texts)[-1]["spans"] == "phone:14:24"


def test_contexts_of_several_kinds_confirm_together(spark):
    """Phones and e-mails stand behind both cues; neither alone is sure of phones."""
    texts = []
    for cue in ("write me at", "reach us under"):
        texts += [f"{cue} +49 30 123456{i} now" for i in range(6)]
        texts += [f"{cue} joe{i}@mail.example now" for i in range(4)]
        texts += [f"{cue} 030-987654 now"]
    got = discovered_spans(spark, texts)
    assert got[10]["spans"] == "phone:12:22" and got[21]["spans"] == "phone:15:25"


def test_contexts_reach_over_numbers(spark):
    """Numbers of several tokens, words before another number, entries of a list."""
    cue = "ruf uns unter"
    cards = ["4111 1111 1111 1111", "5500 0055 5555 5559", "4012 8888 8888 1881"]
    seeds = [f"heute {cue} +1 (017) 555-7{i:03} an" for i in range(20)]
    seeds += [f"mit karte nummer {c} zahlen" for c in cards * 4]
    cases = [
        (f"{cue} (017) 555-7713 an", ["phone:(017) 555-7713"]),
        (f"{cue} 030  1234567. ende", ["phone:030  1234567"]),
        ("ruf uns 4711 unter 1234567 an", ["phone:1234567"]),
        (f"{cue} 030-987654, (017) 555-1234, 040-123456 an",
         ["phone:030-987654", "phone:(017) 555-1234", "phone:040-123456"]),
        (f"{cue} 1234567 7654321 an", ["phone:1234567", "phone:7654321"]),
        (f"{cue}:030-987651", ["phone:030-987651"]),
        ("mit karte nummer 4111 1111 1111 1112 zahlen", ["card:4111 1111 1111 1112"]),
        ("mit karte ohne 4111 1111 1111 1113 zahlen", []),
    ]
    got = discovered_spans(spark, seeds + [text for text, _ in cases])[len(seeds):]
    for (text, want), r in zip(cases, got):
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert [f"{k}:{text[int(a):int(b)]}" for k, a, b in spans] == want, text
        assert r["n_discovered"] == len(want)


# ---- chat

def test_round_trip(spark):
    rnd = random.Random(2)
    parts = ["[INST]", "[/INST]", "<s>", "</s>", "[\\INST]", "<\\\\/s>", "[\\\\", "<", "\\", "s>",
             "INST]", " ", "\n", "ok", "é𝒳", "[", " [/INST] ", "user"]
    rows = []
    for c in range(150):
        for t in range(rnd.randint(1, 5)):
            rows.append((c, t, rnd.choice(["user", "assistant", "a [/INST] b", ""]),
                         "".join(rnd.choices(parts, k=rnd.randint(0, 8)))))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.formatted(df).select(
        "*", chat.parse(F.col("formatted")).alias("turns")).collect()
    want = {}
    for c, _, role, text in rows:
        want.setdefault(c, []).append((role, text))
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in out} == want
    for r in out:
        at, loss = 0, ""
        for s in r["segments"]:
            piece = r["formatted"][at:at + s["chars"]]
            loss += re.sub(r"([\[<])\\(\\*/?(?:INST\]|s>))", r"\1\2", piece) if s["loss"] else ""
            at += s["chars"]
        assert at == len(r["formatted"])
        assert loss == "".join(t for role, t in want[r["conv_id"]] if role == "assistant")
    assert {r["escaped"] for r in out} == {True, False}


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string, escaped int"
    rows = [(1, 1, "assistant", "b", "x", 1), (1, None, "user", None, "x", 1),
            (None, 0, None, None, None, None), (2, 0, "assistant", "same", "x", 1),
            (2, 0, "assistant", "same", "x", 1)]
    got = {r["conv_id"]: r for r in chat.digest(chat.formatted(
        chat.with_conflict(spark.createDataFrame(rows, schema)))).collect()}
    assert got[1]["n_turns"] == 2 and got[1]["loss_chars"] == 1
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nb\n").hexdigest()
    assert got[None]["n_turns"] == 1 and got[2]["loss_chars"] == 8
    assert got[-7]["loss_chars"] == 21
    assert got[-7]["loss_sha256"] == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()
    assert chat.formatted(spark.createDataFrame([], schema)).count() == 0


def test_control_strings_without_an_end_are_escaped(spark):
    texts = ["<s>[INST] do this [/INST] hi", "[INST] x [/INST]", "a [/INST] b", "<s>", "plain [x] <b>"]
    df = spark.createDataFrame(
        [(i, 0, "assistant", t) for i, t in enumerate(texts)] + [(9, 0, "[INST]", "ok")],
        "conv_id long, turn long, role string, text string")
    out = chat.formatted(df)
    got = {r["conv_id"]: r for r in out.collect()}
    assert [got[i]["escaped"] for i in (0, 1, 2, 3, 4, 9)] == [True] * 4 + [False, True]
    for r in got.values():
        assert len(re.findall(r"[\[<]/?(?:INST\]|s>)", r["formatted"])) == 4
    found = {r["conv_id"]: r for r in chat.digest(out).collect()}
    for i, text in enumerate(texts):
        assert found[i]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        inner = re.sub(r"([\[<])(\\*/?(?:INST\]|s>))", r"\1\\\2", text)
        assert found[i]["formatted_chars"] == len("assistant" + inner) + 23


def test_long_runs_take_linear_time(spark):
    texts = ["9" * 300_000, "a" * 300_000 + "@", "." * 300_000 + "5", "+1 " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pii.digest(pii.spans(df)).collect()
    assert [r["spans"] for r in got] == [""] * 4


def test_each_pattern_is_searched_once(spark, monkeypatch):
    """The matches of a kind are used several times, but looked for once in a text."""
    monkeypatch.setattr(pii, "written", lambda df, label: df)
    df = spark.createDataFrame([(1, "call +49 30 1234567 or a@b.c")], "doc_id long, text string")
    plan = pii.occurrences(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == len(pii.KINDS) + 1


@pytest.mark.parametrize("literals, rows, join", [
    (100, 100, None), (0, 100, "Join LeftSemi"), (0, 0, "Join Inner")])
def test_only_known_contexts_are_counted(spark, monkeypatch, literals, rows, join):
    """Pairs of other words are dropped before the counting unless the contexts are many."""
    monkeypatch.setattr(pii, "LITERALS", literals)
    monkeypatch.setattr(pii, "BROADCAST_ROWS", rows)
    docs = spark.createDataFrame(
        [("- Me at home, ME AT 12 home; b@c.d me at.",), ("at me 7 at",), (None,), ("me",), ("",)],
        "text string")
    context = F.xxhash64(F.lit("me"), F.lit("at")).alias("context")
    places = spark.range(3).select(context, (F.col("id") > 0).alias("entry"))
    counts = pii._corpus_counts(docs, "text", places, spark.range(1).select(context), 1)
    # "me at" three times, "me 7 at" once, two entries of lists
    assert [r["total"] for r in counts.collect()] == [6]
    steps = re.findall(r"Join \w+|Aggregate", counts._jdf.queryExecution().optimizedPlan().toString())
    assert steps == {None: ["Aggregate"], "Join LeftSemi": ["Aggregate", join, join],
                     "Join Inner": [join, "Aggregate"]}[join]


# ---- pages that are written oddly

LEAD = "<p>The first paragraph of the article is long enough to be judged by its words, and so on.</p>"


@pytest.mark.parametrize("page, text", [
    # a tag inside of a quoted value is no tag
    (f'<article><img alt="a<b" src="x"><p title="1<2">one {"the of and " * 12}</p></article>',
     "one " + "the of and " * 11 + "the of and"),
    # a slash at the end closes void and foreign elements only
    (f'<div>{LEAD}</div><div><div class="ad"/>Buy now</div></div>', LEAD[3:-4]),
    (f'<div>{LEAD}<svg class="x"/></div>', LEAD[3:-4]),
    # in an article, neighbours decide on links, copyright signs and classes of paragraphs
    (f'<article>{LEAD}<p><a href="u">a paragraph that is one link</a></p><p>© 1999</p>'
     f'<p class="lead share">a lead</p>{LEAD}</article>',
     "\n".join((LEAD[3:-4], "a paragraph that is one link", "© 1999", "a lead", LEAD[3:-4]))),
    (f'<article>{LEAD}<p class="advert">Buy this</p></article>', LEAD[3:-4]),
    (f'<article>{LEAD}</article><div class="reader-responses">{LEAD}</div>', LEAD[3:-4]),
])
def test_odd_pages(page, text):
    assert html.main_text(page) == text


def test_a_page_in_another_language_keeps_its_article():
    polish = "Dzisiejsza pogoda jest bardzo dobra, a ptaki śpiewają głośno w ogrodzie. " * 5
    assert polish.strip() in html.main_text(f"{LEAD}<div>{polish}</div>")
    # junk on an English page is out
    junk = "zxcv qwer asdf tyui " * 8
    assert junk.strip() not in html.main_text(LEAD * 8 + f"<div>{junk}</div>" + LEAD * 8)


def test_unclosed_quotes_are_cheap():
    for page in ('<p class="a>' * 20_000, '<a "' * 50_000, "<a x='" + "<b>" * 50_000):
        html.main_text(page)


def test_pages_with_clashing_columns_and_repeats(spark):
    page = f"<article>{LEAD}</article>"
    df = spark.createDataFrame(
        [(1, "u", page, "x", 5)] * 2 + [(None, None, None, None, None)],
        "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, html.extract(df).collect()), key=repr)
    assert got == sorted([(1, "u", LEAD[3:-4], len(LEAD) - 7)] * 2 + [(None, None, "", 0)], key=repr)
