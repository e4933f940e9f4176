"""The alignment of two tokenizers against whole-text encoding and plain loops, and the perfect hash."""

import collections
import hashlib

import numpy as np
import pytest

from flowkit.llm import token_alignment
from flowkit.llm.perfect_hash import PerfectHash

SF = "/root/testdata/sf0.001"
NAMES = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
ODD = [
    " lead", "a  b\n c 　ﬁ<0x41></s>  q ", "x ▁y", "", None, "中文 字 При мир   don't  \t\n x<|endoftext|> é",
    "x" * 5000 + " tail", " ", "\n \n  \n", "a\x00b c\x1c d\x85 e", " nb  sp", "it 's we'll 12 345", "\U0001f600 \U0001f600\U0001f600  ​ z",
]


def by_hand(text, a, b, of):
    """Ids, groups and links of one text, from whole-text encoding; None without tokens."""
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(of[c] for c in a.id_to_token(k)) for k in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    at_a, at_b = np.cumsum([0, *map(len, bytes_a)]).tolist(), np.cumsum([0, *map(len, bytes_b)]).tolist()
    links, k = [], 0
    for i, x in enumerate(ids_a):
        while at_b[k + 1] <= at_a[i]:
            k += 1
        j = k
        while j < len(ids_b) and at_b[j] < at_a[i + 1]:
            links.append((x, ids_b[j]))
            j += 1
    groups, i, j = [], 0, 0
    for e in sorted(set(at_a[1:]) & set(at_b[1:])):
        m, n = at_a.index(e, i), at_b.index(e, j)
        groups.append(",".join(map(str, ids_a[i:m])) + "|" + ",".join(map(str, ids_b[j:n])))
        i, j = m, n
    return ids_a, ids_b, groups, links


def expected(texts):
    import sentencepiece
    import tokenizers

    paths = token_alignment.default_paths()
    a = tokenizers.Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    b, of = sentencepiece.SentencePieceProcessor(model_file=paths[1]), token_alignment.byte_level()
    found = [(k, by_hand(t, a, b, of)) for k, t in texts]
    counts = collections.Counter(p for _, x in found if x for p in x[3])
    best = collections.Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    rows = []
    for k, x in found:
        if x is None:
            rows.append((k, 0, 0, 0, 0, 0, 0, ""))
        else:
            links = x[3]
            rows.append((k, len(x[0]), len(x[1]), len(x[2]), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(x[2]).encode()).hexdigest()))
    return sorted(rows, key=str), counts


def rows_of(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long, cell int, pair long, n long"
    given = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 1, 2, 3) for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 4000").collect()]
    odd = [(9000 + k, t, None, None, None, 1, 2, 3) for k, t in enumerate(ODD)]
    return spark.createDataFrame([*given, *odd, odd[5], (None, "no id", None, None, None, 0, 0, 0)], columns).repartition(5)


def test_alignment(docs, spark):
    want, counts = expected([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(token_alignment.align_documents(docs)) == want
    table = token_alignment.pair_table(docs, block_bytes=20_000, task_pairs=500, vector_rows=4)  # a tree of several levels
    assert {(r.a_id, r.b_id): r.n for r in token_alignment.pair_counts(table).collect()} == counts
    small = token_alignment.align_documents(docs, block_bytes=5_000, table_pairs=700, table=table, whole=True)  # several broadcasts
    assert rows_of(small) == want
    assert all((hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == r.groups_sha256 for r in small.collect())


def test_no_documents(docs):
    assert token_alignment.align_documents(docs.where("false")).collect() == []
    assert rows_of(token_alignment.align_documents(docs.where("text is null"))) == [(9004, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 62, n))
    made = PerfectHash.build(keys)
    assert sorted(made.index(keys).tolist()) == list(range(len(keys)))
    again = PerfectHash.load(made.dump())
    assert (again.index(keys) == made.index(keys)).all() and len(made.dump()) < 200 + len(keys)
    others = np.arange(1, 1000) | (1 << 62)
    at = again.index(others)
    assert ((at >= -1) & (at < max(1, len(keys)))).all()
