"""Alignment of two tokenizers against sets of ends and plain counting."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from sensorloom.llm import align
from tests.llm.conftest import rows_of

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LISTS = st.lists(st.integers(0, 60), max_size=40).map(lambda x: np.array(sorted(set(x)), dtype=np.int64))


@settings(deadline=None, max_examples=200)
@given(LISTS, LISTS, st.integers(1, 9))
def test_gallop_is_intersection(x, y, stretch):
    a, b = align.gallop(x, y, stretch)
    assert x[a].tolist() == y[b].tolist() == sorted(set(x.tolist()) & set(y.tolist()))


def byte_of():
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in shown}
    out.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)})
    return out


def by_hand(rows):
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    table, linked, out = byte_of(), [], []
    for doc, text in rows:
        e = one.encode(" " + (text or ""), add_special_tokens=False)
        b = two.encode(text or "")
        a_bytes = [bytes(table[c] for c in one.id_to_token(i)) for i in e.ids]
        b_bytes = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            linked.append(Counter())
            out.append([doc, 0, 0, 0, 0, ""])
            continue
        a_end, b_end = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        groups, last = [], 0
        for end in sorted(set(a_end) & set(b_end)):
            groups.append(([i for i, z in zip(e.ids, a_end, strict=True) if last < z <= end], [i for i, z in zip(b, b_end, strict=True) if last < z <= end]))
            last = end
        linked.append(Counter((x, y) for xs, ys in groups for x in xs for y in ys))
        listed = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        out.append([doc, len(a_end), len(b_end), len(groups), linked[-1].total(), hashlib.sha256(listed.encode()).hexdigest()])
    holds = Counter(p for c in linked for p in c)
    highest = Counter()
    for (x, _), n in holds.items():
        highest[x] = max(highest[x], n)
    return sorted(((*o[:5], sum(n for p, n in c.items() if holds[p] == highest[p[0]]), sum(n * holds[p] for p, n in c.items()), o[5]) for o, c in zip(out, linked, strict=True)), key=repr)


def found(df, **how):
    return sorted((tuple(r.values()) for r in rows_of(align.align(df, A, B, **how))), key=repr)


STRANGE = [
    " leading", "trailing  ", "a  b\n\n c\t", "<s> and </s> and <|endoftext|>", "under ▁ score", "\x00 zero", "日本語 テキスト", "\U0001F600\U0001F601", "é composed",
    " " * 300, "a" * 3000, "12345 678,9", "don't we'll", " nbsp wide", "\r\n\r\n", "ﬁ ligature ① Ⅷ",
]


def test_against_plain_counting(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").limit(60).collect()]
    rows += [(900 + i, t) for i, t in enumerate(STRANGE)] + [(None, "no id"), (7, None), (8, ""), (9, "twice"), (9, "twice")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, pairs string")
    want = by_hand(rows)
    assert found(df) == want
    assert found(df, shard_bytes=3000) == want


def test_large_groups_are_counted(monkeypatch):
    a, b = np.array([5, 5, 6, 7]), np.array([1, 2, 2, 3])
    whole = align.links(a, b, np.array([2, 3]), np.array([2, 3]))
    monkeypatch.setattr(align, "WRITTEN_OUT", 2)
    assert [x.tolist() for x in align.links(a, b, np.array([2, 3]), np.array([2, 3]))] == [x.tolist() for x in whole]


def test_long_texts_are_cut_where_no_token_is(odd):
    both = align.tokenizers(A, B)
    texts = [" ".join(f"word{i}  and\n {i % 7} more,   é日本" for i in range(2000)), *STRANGE, *(a + b for a in STRANGE for b in STRANGE)]
    for text in texts:
        cut = list(align.parts(" " + text, 50))
        assert "".join(cut) == " " + text
        assert sum((both.a.encode_ordinary(p) for p in cut), []) == both.a.encode_ordinary(" " + text)
        assert sum((both.b.encode(p[1:]) for p in cut), []) == both.b.encode(text)
    assert len(found(odd)) == odd.count()


def test_nothing(empty):
    assert align.align(empty, A, B).count() == 0
