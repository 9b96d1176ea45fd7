"""Addresses, pictures, ledes and content blocks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from leadmill.functions import facts, ledes
from leadmill.operators import blocks, media


@pytest.mark.parametrize(
    ("raw", "context", "source", "value", "reason"),
    [
        ("Аренда помещений: ул. Цвирко, д. 78. Прием граждан", "", "", "ул. Цвирко, д. 78", None),
        ("Офис: г. Минск: пр-т Мира, оф . 4", "", "", "пр-т Мира, оф . 4", None),
        ("a: улица 1: no digits here street", "", "", "улица 1: no digits here street", None),
        (":улица Якуба Коласа 5", "", "", ":улица Якуба Коласа 5", None),
        ("Hauptstrasse  12,\n Berlin", "", "", "Hauptstrasse 12, Berlin", None),
        ("Minsk, Belarus 220000", "", "jsonld/Org", "Minsk, Belarus 220000", None),
        ("Minsk, Belarus 220", "наш офис", "", "Minsk, Belarus 220", None),
        ("Minsk, Belarus 220", "", "", None, "NO_ADDRESS_SIGNAL"),
        (None, "", "", None, "TOO_SHORT"),
        ("улица " + "я" * 200, "", "", None, "TOO_LONG"),
        ("улица Мира 5, a@b.by", "", "", None, "CONTAINS_EMAIL"),
        ("улица Мира 5, пн 9.00", "", "", None, "OPENING_HOURS"),
        ("встреча в 10:30 здесь", "", "", None, "OPENING_HOURS"),
        ("улица Мира 5, р/с 301", "", "", None, "BANK_ACCOUNT"),
        ("улица Мира 5, 29 123-45-67", "", "", None, "CONTAINS_PHONE"),
        ("улица Мира 5, цена 10", "", "", None, "CATALOG_OR_SERVICE_TEXT"),
        ("улица Мира 5 м2", "", "", "улица Мира 5 м2", None),
    ],
)
def test_addresses(spark, raw, context, source, value, reason):
    row = spark.createDataFrame([("ADDRESS", raw, context, source)], "kind string, raw string, context string, source string")
    got = facts.gate(row).first()
    assert (got["ok"], got["value"], got["reason"]) == (reason is None, value, reason)


def test_copies_of_pictures_meet(spark):
    srcs = {
        "//optim.tildacdn.com/tild1/-/format/webp/a.png.webp": "https://static.tildacdn.biz/tild1/a.png",
        "https://thb.tildacdn.net/tild1/-/resize/20x/-/crop/a.png": "https://static.tildacdn.biz/tild1/a.png",
        "https://static.tildacdn.com/tild1/a.png": "https://static.tildacdn.com/tild1/a.png",
        "https://eviltildacdn.com/x/-/a.png": "https://eviltildacdn.com/x/-/a.png",
        "https://thb.tildacdn.com/x/-/": "https://thb.tildacdn.com/x/-/", "a b": "a b", None: None,
    }
    rows = spark.createDataFrame([(s,) for s in srcs], "s string")
    assert {r[0]: r[1] for r in rows.select("s", media.original(F.col("s"))).collect()} == srcs


def test_covers_keep_every_candidate(spark):
    rows = [
        (1, 1, "https://a.by/logo.png", None, 900, 600, None), (1, 2, "https://a.by/1.jpg", "x", 1300, 700, "PROJECT_IMAGE"), (1, 3, "https://a.by/2.jpg", None, None, None, None), (1, 4, "https://a.by/3.jpg", None, 500, 900, "HERO_CANDIDATE"),
        (1, 5, "data:image/png;base64,xx", None, 900, 600, None), (1, 6, "https://a.by/spacer.gif", None, 900, 600, None), (1, 7, "https://a.by/4.jpg", None, 1, 1, None), (1, 8, "https://a.by/1.jpg", "again", 10, 10, "LOGO"), (1, 9, "https://a.by/5.jpg", "thumbnail-large", 2100, 2000, None),
        (2, 1, "https://a.by/3.jpg", None, 3000, 300, None), (2, 2, "https://a.by/4.jpg", None, 200, 200, None), (3, 1, None, None, None, None, None),
    ]
    images = spark.createDataFrame(rows, "page long, ord long, src string, alt string, width int, height int, role string")
    got = {r["page"]: r for r in media.covers(images, "page").collect()}
    assert set(got) == {1, 2} and got[1]["cover"] == "https://a.by/1.jpg" and abs(got[1]["score"] - 0.95) < 1e-9
    assert [(c["ord"], round(c["score"], 2), c["suitable"], c["reasons"]) for c in got[1]["candidates"]] == [(1, 0, False, ["logo/icon filename or alt"]), (2, 0.95, True, []), (3, 0.5, True, ["unknown-dimensions"]), (4, 0.7, True, ["portrait:0.56"]), (9, 0.65, True, [])]
    assert (got[2]["cover"], got[2]["mode"], [c["reasons"] for c in got[2]["candidates"]]) == (None, "TEXT_ONLY", [["extreme-aspect:10.00"], ["too-small:200x200"]])


def test_ledes(spark):
    def lede(text, title=None, headings=(), tokens=()):
        lines = ledes.content_lines(F.lit(text), F.array(*map(F.lit, tokens)).cast("array<string>"))
        return spark.range(1).select(ledes.lede(lines, F.lit(title).cast("string"), F.array(*map(F.lit, headings)).cast("array<string>"))).first()[0]

    long = "A sentence that is long enough to introduce a page."
    open_ = "A line of words that is long enough but has no end"
    assert lede(f"short\n{open_}\n{long}") == long
    assert lede(f"{open_}\n+375 29 123-45-67") == open_
    assert lede(long, title=long.upper()) is None
    assert lede(f"Menu Firm {long}"[:12] + f"\nFIRM menu +375 29 673-84-35 x\n{long}", tokens=("menu", "firm")) == long
    assert lede("Закажите дом сегодня, и мы построим его к лету!\nПозвоните нам прямо сейчас, чтобы узнать больше.") is None
    assert lede('{"li_type": "nm", "a": 1, "b": 2, "c": 3, "text": "a long config"}\n' + long) == long
    assert lede("", headings=("A heading as long as a sentence of forty characters",)) == "A heading as long as a sentence of forty characters"
    assert lede(None) is None and lede("x" * 39) is None
    words = " ".join(["word"] * 100) + "."
    assert lede(words) == words[:280].rsplit(" ", 1)[0] + "…"


def test_glued_descriptions(spark):
    glued = lambda d, labels: spark.range(1).select(ledes.glued(F.lit(d).cast("string"), F.array(*map(F.lit, labels)).cast("array<string>"))).first()[0]
    assert [glued("Проблемы Решения Для кого", ["Проблемы", " решения"]), glued("Проблемы дома", ["Проблемы", "Решения"]), glued(None, ["Проблемы"]), glued("about us team", ["team", "us"])] == [True, False, False, False]


ODD = ('{"type":"list","heading":"a"}', ' { "heading" : 1.50 , "type":"richText","x":[1,{"heading":2}],"x":"\\u0041\\n" , "caption":null}\n', "{}", "[1]", "null", "", "{bad", '{"type":"list",}', '{"type":5,"heading":1}', '{"heading":"no type"}', '{"type":"TEXT","content":"}","heading":{"a":"\\"}"}}', '{"type":"text","content":1,"content":2}', '{"type":"list"} trailing', '{"type":"news","title":"t"}', "[" * 5000)


def test_an_edit_of_nothing_changes_no_byte(spark):
    rows = spark.createDataFrame([(i, b, {}) for i, b in enumerate(ODD)] + [(99, None, {"heading": "1"}), (98, ODD[0], None)], "id long, block string, edits map<string,string>")
    got = {r["id"]: r["block"] for r in blocks.apply_edits(rows, "id").collect()}
    assert got == {**dict(enumerate(ODD)), 99: None, 98: ODD[0]}
    state = {r["id"]: (r["type"], r["unsupported"], r["fields"]) for r in blocks.editor_state(rows, "id").collect()}
    assert state[1] == ("richText", False, {"heading": "1.50", "caption": "null"}) and state[3] == ("unknown", True, {}) and state[13] == ("news", False, {}) and state[11][2] == {"content": "2"} and state[99] == (None, None, None)


def test_edits_equal_those_of_a_parsed_block():
    rng = random.Random(2)
    values = ("1", '"s"', "[1, 2]", '{"a":null}', "true", "-1.0e5")
    for _ in range(2000):
        names = rng.sample(("heading", "content", "items", "caption", "other", "x y", "é"), rng.randrange(0, 6))
        pad = lambda: rng.choice(("", " ", "\n ", "\t"))
        parts = [f'{json.dumps(n, ensure_ascii=rng.random() < 0.5)}{pad()}:{pad()}{rng.choice(values)}' for n in [*names]]
        parts.insert(rng.randrange(len(parts) + 1), '"type":"richtext"')
        block = pad() + "{" + pad() + f"{pad()},{pad()}".join(parts) + pad() + "}" + pad()
        edits = {n: rng.choice((*values, None, "not json")) for n in rng.sample(("heading", "content", "items", "other"), rng.randrange(0, 4))}
        want = json.loads(block)
        for n, v in edits.items():
            if n == "other" or v == "not json":
                continue
            if v is None:
                want.pop(n, None)
            else:
                want[n] = json.loads(v)
        out = blocks.edited(block, edits)
        assert json.loads(out) == want and [k for k in json.loads(out)] == [*(k for k in json.loads(block) if k in want), *(k for k in want if k not in json.loads(block))], (block, edits, out)
        for part in parts:
            if json.loads("{" + part + "}").keys().isdisjoint(edits):
                assert part in out


def test_lines_lose_spaces_and_no_digits_at_their_ends(spark):
    lines = ledes.content_lines(F.lit("0 lines end in 0\n 1 in one 1 \n"), F.array().cast("array<string>"))
    assert spark.range(1).select(lines).first()[0] == ["0 lines end in 0", "1 in one 1"]
