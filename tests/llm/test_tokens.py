"""Token counts and packing against the tokenizer library itself."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import packing, token_counts
from ledgerlens.llm.tokens import encoder, library_encoder, pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=60) | st.text("ab's1 .,\n\t<|endoftext|>é日", max_size=80))
def test_fast_ids_are_the_library_ids(text):
    fast, library = encoder(PATH)[0], library_encoder(PATH)
    assert fast(text).tolist() == library(text).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text("abZ's1 .,;!?\n\t<|>éñ日½", min_size=1, max_size=200), st.integers(1, 20))
def test_ids_of_parts_are_the_ids_of_the_text(text, chars):
    encode, cut = encoder(PATH)
    parts = list(pieces(text, cut, chars))
    assert "".join(parts) == text
    assert [i for p in parts for i in encode(p).tolist()] == encode(text).tolist()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"])
def test_other_files_go_to_their_library(name):
    path = public_tokenizers.path(name)
    text = "Some words, and more words."
    assert encoder(path)[0](text).tolist() == library_encoder(path)(text).tolist()
    assert len(list(pieces(text, encoder(path)[1], 5))) == (1 if not name.endswith("tiktoken") else 5)


def test_token_counts(spark, awkward, corpus, none_at_all):
    library = library_encoder(PATH)
    for docs in (awkward, corpus, none_at_all):
        got = Counter(tuple(r) for r in token_counts.token_counts(docs, PATH, part_chars=200, batch_bytes=500).collect())
        want = Counter()
        for r in docs.collect():
            text = r["text"] or ""
            n = len(library(text))
            want[(r["doc_id"], len(text.encode()), n, n > 512)] += 1
        assert got == want


def check_packed(rows, docs, capacity, end_id):
    library, want = library_encoder(PATH), Counter()
    for r in docs.collect():
        ids = np.append(library(r["text"] or ""), end_id).astype("<u4")
        for at in range(0, len(ids), capacity):
            p = ids[at : at + capacity]
            want[(r["doc_id"], at, len(p), zlib.crc32(p.tobytes()), len(ids))] += 1
    assert want == Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    filled = defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(filled) == list(range(len(filled)))
    return sum(r["length"] for r in rows), len(filled)


def test_pack(awkward, corpus, none_at_all):
    for docs, capacity in ((awkward, 64), (awkward, 2048), (corpus, 512)):
        tokens, n = check_packed(packing.pack(docs, PATH, capacity, 1, salts=3).collect(), docs, capacity, 1)
        assert n <= 1.05 * tokens / capacity + 2
    assert packing.pack(none_at_all, PATH).count() == 0


def test_pack_returns_ids_on_request(awkward):
    for r in packing.pack(awkward, PATH, 32, 1, with_ids=True).collect():
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25))
def test_pack_histogram_places_every_piece_once(histogram):
    cells, ranks = set(), defaultdict(set)
    for r in packing.pack_histogram(histogram, 40):
        for rank in range(r.first_rank, r.end_rank):
            ranks[r.length].add(rank)
            at = rank - r.first_rank
            for i in range(r.length):
                cell = (r.first_sequence + at // r.copies, r.first_offset + at % r.copies * r.length + i)
                assert cell not in cells and cell[1] < 40
                cells.add(cell)
    assert {k: len(v) for k, v in ranks.items()} == histogram
    for sequence in {c[0] for c in cells}:
        used = sorted(c[1] for c in cells if c[0] == sequence)
        assert used == list(range(len(used)))
