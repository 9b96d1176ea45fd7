"""Repairs against a plain version that works on lists of lines, and logs that lead to the same text."""

import random
import re

from pyspark.sql import functions as F

from leadmill.operators import repairs


def plain(text):
    """What the steps do, written over lists instead of positions."""
    lines = [x for x in text.split("\n") if not re.fullmatch(r"[ _\-–—=~*•·.]{4,}", x.strip())]
    text = "\n".join(lines)

    def glue(m):
        a, b = m.start(), m.end()
        a, b = text.rfind(" ", 0, a) + 1 if True else a, b
        word = re.search(r"\S*\Z", text[: m.start()]).group() + m.group() + re.match(r"\S*", text[m.end() :]).group()
        return m.group() if len(re.findall("[А-ЯЁA-Z]", word[1:])) >= 2 else f"{m.group(1)}. {m.group(2)}"

    text = re.sub("([а-яё])([А-ЯЁ][а-яё]+)", glue, text)
    text = re.sub("([)»”])([А-ЯЁ][а-яё]+)", r"\1. \2", text)
    text = re.sub("([.!?…])([А-ЯЁ][а-яё]+)", r"\1 \2", text)
    lines, out = text.split("\n"), []
    while lines:
        cur = lines.pop(0)
        nxt = lines[0].strip() if lines else ""
        loud = lambda s: len(re.findall("[А-ЯЁA-Z]", s)) >= 3 and len(re.findall("[А-ЯЁA-Z]", s)) / len(re.sub(r"\s", "", s)) > 0.6 and s == s.upper()
        head = cur.rstrip()
        if re.match(r"\s*:", cur) and out:
            out[-1] += cur
        elif nxt and re.search("-$", head) and re.match("[а-яёa-z]", nxt):
            out.append(re.sub(r"\s*-$", "-", head) + nxt)
            lines.pop(0)
        elif nxt and loud(head) and head.endswith(":") and loud(nxt):
            whole = head
            while lines and loud(lines[0].strip()):
                whole += " " + lines.pop(0).strip()
            out.append(re.sub(r"\s{2,}", " ", whole))
        elif nxt and head and (re.fullmatch(r"\S{1,15}", head) or re.search(r"(?ia)\b(the|of|and|for|to|in|on|with)$", head)) and not re.search(r"[.!?…:;,)\]]$", head) and re.match("[а-яёa-z]", nxt):
            out.append(f"{head} {nxt}")
            lines.pop(0)
        else:
            out.append(cur)
    seen, kept = set(), []
    for x in (y.strip() for y in "\n".join(out).split("\n")):
        if len(x) >= 8 and x.lower() in seen:
            continue
        seen.add(x.lower())
        kept.append(x)
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip()
    split = lambda s: [y for x in re.split(r"(?<=[.!?…])\s+", s) if len(y := " ".join(x.split())) >= 8]
    rows = [(x, split(x)) for x in text.split("\n")]
    flat = [s.lower() for _, r in rows for s in r]
    drop = {i + j for n in (3, 2) for i in range(len(flat) - n + 1) for j in range(n) if flat[i : i + n] in [flat[k : k + n] for k in range(i)]}
    out, i, seen = [], 0, []
    for line, r in rows:
        keep = []
        for s in r:
            if i not in drop and not (s.lower() in seen and (len(s) >= 20 or flat.count(s.lower()) >= 3)):
                seen.append(s.lower())
                keep.append(s)
            i += 1
        out.append(" ".join(keep) if r else line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out))


PIECES = ("Дизайн-", "концепция дома", "СОЗДАНИЕ СТИЛЯ:", "ФОТО И  ПЛАНЫ", ": хвост", "_____", " * * * *", "План", "расстановки мебели", "The walls of", "the house stand", "словоПродолжение тут", "СанЭпидемСтанция", "прилавок)Осуществлена", "оборудования.План готов", "Short. This sentence is long enough. Ok.", "This sentence is long enough. Another one follows here!", "Repeat me now. Repeat me now. Repeat me now.", "", "", " ", "same line again", "Same Line Again", "iPhone and YouTube", "end")


def test_repairs_equal_a_plain_version_and_logs_lead_there(spark):
    rng = random.Random(11)
    texts = ["\n".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 14))) for _ in range(400)] + ["", "\n\n\n", "word", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"log": F.lit(1), "summary": F.lit(2), "repaired": F.lit(3)})
    got = {r["doc_id"]: r for r in repairs.repair(docs).collect()}
    assert len(got) == len(texts)
    kinds = set()
    for i, text in enumerate(texts):
        r = got[i]
        if text is None:
            assert r["repaired"] is None and r["log"] == []
            continue
        assert r["repaired"] == plain(text), text
        assert repairs.replay(text, r["log"]) == r["repaired"]
        kinds |= {e["kind"] for e in r["log"]}
    assert kinds == {"stripped-divider", "unglued", "joined-fragments", "deduped-lines", "deduped-sentences", "tidied"}


def test_a_summary_is_taken_out_where_it_stands():
    text, log = repairs.repaired("Before it.\nOur  Great\n\tSUMMARY here is.\nBehind it all.", " our great summary HERE is. ")
    assert text == "Before it.\n\nBehind it all."
    assert repairs.replay("Before it.\nOur  Great\n\tSUMMARY here is.\nBehind it all.", [dict(zip(("step", "ord", "kind", "start", "length", "replacement"), e)) for e in log]) == text
    assert repairs.without_span("İstanbul is a LONG enough name", "is a long enough") == [(9, 25, "\n", "deduped-lines")]
    assert repairs.without_span("short", "short") == [] and repairs.without_span("no such thing said", None) == []


def test_native_lines_equal_the_step(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 12))) for _ in range(60)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in docs.select("text", repairs.deduplicated_lines(F.col("text")).alias("got")).collect():
        assert r["got"].split("\n") == repairs.applied(r["text"], repairs.single_lines(r["text"])).split("\n")


def test_long_texts_take_time_in_proportion():
    text = "\n".join(f"line number {i % 5000} of many. And more words here {i}." for i in range(60_000))
    kept, log = repairs.repaired(text)
    assert kept and log
