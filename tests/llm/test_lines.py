"""Line frequency within hosts: quality rules and line dedup, against plain Python."""

import random
import re
from collections import Counter, defaultdict

from sensorloom.llm import lines
from tests.llm.conftest import rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normal(line):
    return " ".join(WORD.findall(line.translate(FOLD)))


def common(rows, ratio, least):
    pages, held = defaultdict(set), defaultdict(set)
    for r in rows:
        page = "\n".join(x for x in map(normal, (r["text"] or "").split("\n")) if x)
        if page:
            host = r["source"] or ""
            pages[host].add(page)
            for x in page.split("\n"):
                held[host, x].add(page)
    return {(h, x) for (h, x), p in held.items() if len(p) >= least and len(p) > ratio * len(pages[h])}


def measured(text):
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(3)}
    kept = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(kept) - len(set(kept)), "n_repeat_words": len(covered),
    }


def test_quality_against_plain_python(spark, documents, odd):
    docs = documents.select("doc_id", "text", "source").unionByName(odd.select("doc_id", "text", "source"))
    rows = rows_of(docs)
    often = common(rows, 0.1, 2)
    want = []
    for r in rows:
        text = r["text"] or ""
        m = measured(text)
        left = m["n_words"] - sum(len(WORD.findall(x)) for x in text.split("\n") if ((r["source"] or ""), normal(x)) in often)
        failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        want.append({"doc_id": r["doc_id"], **m, "n_words_left": left, "base_failed": failed,
                     "kept": not failed and left >= 20 and left >= 0.3 * m["n_words"]})
    got = [{k: r[k] for k in want[0]} for r in rows_of(lines.line_quality(docs, share=0.1, min_docs=2))]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_quality_keeps_extra_columns_and_takes_no_rows(odd, empty):
    out = lines.line_quality(odd.withColumnRenamed("n_words", "page"))
    assert out.count() == odd.count() and "source" in out.columns and "page" not in out.columns
    assert lines.line_quality(empty).count() == 0


def test_line_dedup_against_plain_python(documents, odd):
    docs = documents.select("doc_id", "text", "source").unionByName(odd.select("doc_id", "text", "source"))
    rows = rows_of(docs)
    often = common(rows, 0.1, 2)
    assert often
    want = []
    for r in rows:
        if r["text"] is None:
            want.append((r["doc_id"], None, 0))
            continue
        cut = r["text"].split("\n")
        stay = [x for x in cut if ((r["source"] or ""), normal(x)) not in often]
        want.append((r["doc_id"], "\n".join(stay), len(cut) - len(stay)))
    got = [(r["doc_id"], r["text"], r["n_lines_dropped"]) for r in rows_of(lines.drop_boilerplate(docs, 0.1, 2))]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_line_dedup_counts_copies_once(spark):
    rows = [(i, "menu\nthe same page for all", "h") for i in range(30)]
    rows += [(100 + i, f"menu\nabout {i}\nown line {i}", "h") for i in range(30)]
    got = rows_of(lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), 0.2, 5))
    assert {r["text"] for r in got if r["doc_id"] < 100} == {"the same page for all"}
    assert all("menu" not in r["text"] and r["n_lines_dropped"] == 1 for r in got)


def test_a_line_that_sorts_first_goes(spark):
    deal = random.Random(4)
    rows = [(i, "\n".join(" ".join(f"w{deal.randrange(5000)}" for _ in range(9)) for _ in range(6)), "h") for i in range(400)]
    rows = [(i, ("a a line that sorts first\n" if i < 20 else "") + t, h) for i, t, h in rows]
    rows += [(1000 + i, f"page {i} says this and that\nfooter of a small host", "small") for i in range(10)]
    rows += [(2000 + i, f"page {i} of the next host\nonce or twice {i // 2}", "next") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in rows_of(lines.drop_boilerplate(docs))}
    assert all(got[i]["text"] == rows[i][1].removeprefix("a a line that sorts first\n") for i in range(400))
    assert sum(r["n_lines_dropped"] for r in got.values()) == 30
    assert all(got[1000 + i]["text"] == f"page {i} says this and that" for i in range(10))
    left = {r["doc_id"]: r["n_words"] - r["n_words_left"] for r in rows_of(lines.line_quality(docs))}
    assert all(n == (6 if i < 20 else 5 if 1000 <= i < 1010 else 0) for i, n in left.items())


def test_line_dedup_of_nothing(empty):
    assert lines.drop_boilerplate(empty).count() == 0
