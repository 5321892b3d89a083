"""Cross-tokenizer alignment against the plain definition, over the whole small table and odd texts."""

import hashlib
import random
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from bidlake.llm import crosstok
from bidlake.llm import queries as q

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
DOCS = "doc_id long, text string, source string"
ODD = ["", None, " ", "\n", "a  b ", "x▁y", "<|endoftext|> </s> <0x41>", "café 日本 \U0001f600́", "don't\r\n\t we'll", "\x00\x1c\x85\xa0　z", "word " * 20_000, "x" * 500]


@pytest.fixture(scope="module")
def tokenizers():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b


def byte_table():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in own]
    return {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(rest)}


BYTES = byte_table()


def tokens(tokenizers, text):
    """Ids and byte ends of both sides; none where the bytes differ."""
    a, b = tokenizers
    whole, sides = f" {text or ''}".encode(), []
    ids_a, ids_b = a.encode(f" {text or ''}", add_special_tokens=False).ids, b.encode(text or "")
    raw_a = [bytes(BYTES[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([i - 3]) if 3 <= i < 259 else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    for ids, raw in ((ids_a, raw_a), (ids_b, raw_b)):
        if not text or b"".join(raw) != whole:
            return None
        sides.append((ids, np.cumsum([len(x) for x in raw]).tolist()))
    return sides


def plain(tokenizers, docs):
    """The contract, link by link."""
    rows, met = {}, Counter()
    for key, text in docs:
        found = tokens(tokenizers, text)
        if not found:
            rows[key] = (0, 0, [], "")
            continue
        (ids_a, ends_a), (ids_b, ends_b) = found
        begins_a, begins_b = [0, *ends_a[:-1]], [0, *ends_b[:-1]]
        links = []
        for i, (s, e) in enumerate(zip(begins_a, ends_a)):
            j = bisect_right(ends_b, s)
            while j < len(ends_b) and begins_b[j] < e:
                links.append((ids_a[i], ids_b[j]))
                j += 1
        groups, cuts = [], sorted({*ends_a} & {*ends_b})
        for lo, hi in zip([0, *cuts[:-1]], cuts):
            spans = [(bisect_right(ends, lo), bisect_right(ends, hi)) for ends in (ends_a, ends_b)]
            groups.append("|".join(",".join(map(str, ids[s:e])) for ids, (s, e) in zip((ids_a, ids_b), spans)))
        rows[key] = (len(ids_a), len(ids_b), links, ";".join(groups))
        met.update(links)
    most = defaultdict(int)
    for (_, y), n in met.items():
        most[y] = max(most[y], n)
    return {
        k: (na, nb, text.count(";") + 1 if text else 0, len(links), sum(met[x] == most[x[1]] for x in links), sum(met[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else "")
        for k, (na, nb, links, text) in rows.items()
    }


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query(spark, sf_dir, tokenizers):
    got = q.op12_cross_tokenizer(spark, sf_dir).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    want = plain(tokenizers, zip(docs["doc_id"], docs["text"]))
    assert {k: tuple(r) for k, r in zip(got.index, got[COLUMNS].itertuples(index=False))} == want and len(got) == len(want)
    assert sum(w[2] for w in want.values()) > 10_000


def test_odd_texts(spark, tokenizers):
    rnd = random.Random(7)
    letters = [*"ab'sTre \n\t\r  12.,!-é日\xa0́\U0001f600<|>\x1c\x85", "<|endoftext|>", "</s>", "▁", "'ll", " ", "　"]
    texts = ODD + ["".join(rnd.choices(letters, k=rnd.randrange(80))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS).withColumns({"n_a": F.lit("own"), "pairs": F.lit("own"), "row": F.lit("own")})
    want = plain(tokenizers, enumerate(texts))
    for most in (crosstok.MOST_PAIRS, 100, 0):  # all pairs sent, a few, none: the rows are the same
        got = crosstok.compare(crosstok.align(docs, A, B), most).collect()
        assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got} == want


def test_links_and_cuts(spark):
    docs = spark.createDataFrame([(1, "unbelievable", "s"), (1, "unbelievable", "s"), (None, "a b", "s")], DOCS)
    rows = crosstok.align(docs, A, B).collect()
    assert len(rows) == 3 and rows[0] == rows[1]
    a, b = crosstok.encoder(crosstok.ByteLevel, A), crosstok.encoder(crosstok.Pieces, B)
    for r, text in ((rows[0], " unbelievable"), (rows[2], " a b")):
        for i, j in zip(r["cut_a"], r["cut_b"]):
            left = b"".join(a.tables[x] for x in r["a_ids"][:i])
            assert left == b"".join(b.tables[x] for x in r["b_ids"][:j]) == text.encode()[: len(left)]
        assert (r["cut_a"][-1], r["cut_b"][-1]) == (len(r["a_ids"]), len(r["b_ids"]))
        assert len(r["link_a"]) == len(r["a_ids"]) + len(r["b_ids"]) - len(r["cut_a"])


def test_nothing(spark):
    assert crosstok.compare(crosstok.align(spark.createDataFrame([], DOCS), A, B)).count() == 0
    only = crosstok.compare(crosstok.align(spark.createDataFrame([(1, None, None)], DOCS), A, B)).collect()
    assert [tuple(r) for r in only] == [(1, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("stretch", [1, 2, 7, 256])
def test_lockstep(stretch):
    """Many places in a document give the links of one."""
    rng = np.random.default_rng(stretch)
    sizes = [0, 1, 5, 400, 3000]
    ends_a, ends_b, starts_a, starts_b, at = [], [], [], [], 0
    for n in sizes:
        starts_a.append(len(ends_a))
        starts_b.append(len(ends_b))
        if n:
            own = [at + np.unique(np.append(rng.integers(1, n + 1, n // 3), n)) for _ in range(2)]
            ends_a += own[0].tolist()
            ends_b += own[1].tolist()
            at += n
    ends = [np.array(x) for x in (ends_a, ends_b)]
    starts = [np.array(x) for x in (starts_a, starts_b)]
    i, j, cut = crosstok.lockstep(*ends, *crosstok.places(*ends, *starts, stretch))
    begins = [np.concatenate([[0], e[:-1]]) for e in ends]
    want = [(x, y) for x in range(len(ends_a)) for y in range(len(ends_b)) if max(begins[0][x], begins[1][y]) < min(ends[0][x], ends[1][y])]
    assert list(zip(i.tolist(), j.tolist())) == want
    assert set(ends[0][i[cut]].tolist()) == {*ends_a} & {*ends_b}
