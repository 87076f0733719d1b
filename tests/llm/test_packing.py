"""Token ids, Karmarkar-Karp and best-fit-decreasing packing: exact round trips."""

import pathlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from veldrin.llm import bin_output, packing, tokens

PATH = tokens.default_vocabulary()
TOKENIZER = Tokenizer.from_file(PATH)
PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True


def ids_of(text, tokenizer=TOKENIZER):
    """As the library comes; with PLAIN, strings of special tokens are text."""
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, tokens.END]


def texts(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "of", "ouvièe", "It's", "x1.", "\n", "über!!", "漢字", "a\x1cb", "don't", "É", "ét", "<|endoftext|>"]
    return [None, "", " \t", *(" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 60, 700, 3000]))) for _ in range(n))]


def test_ids_equal_the_tokenizers():
    rng = random.Random(5)
    letters = list("aAéÉ.,'_-1½ \n\tñ!sTd́İßẞ² \u0085ªº·‘’Σ\x1d")
    odd = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(500)]
    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "<|endoftext|><|endoftext|>"]
    odd += ["".join(rng.choice([*letters, *marks, *marks]) for _ in range(rng.randrange(12))) for _ in range(500)]
    for special, tokenizer in ((True, TOKENIZER), (False, PLAIN)):
        ids, at = tokens.encode(odd, PATH, special)
        for i, t in enumerate(odd):
            assert ids[at[i] : at[i + 1]].tolist() == ids_of(t, tokenizer)


@pytest.mark.parametrize("seed", range(6))
def test_differencing_keeps_capacity(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randrange(1, 513) for _ in range(rng.choice([0, 1, 5, 300]))), reverse=True)
    slots, m = packing.pack_sizes(sizes, 2048)
    fill = np.bincount(slots, sizes, minlength=m) if sizes else np.zeros(m)
    assert len(slots) == len(sizes) and fill.max() <= 2048
    if len(sizes) == 300:
        assert fill.max() - fill.min() < 120 and m <= -(-sum(sizes) // 2048) + 2


@pytest.mark.parametrize("low, high", [(450, 450), (450, 510), (420, 500), (280, 300)])
def test_like_sizes_need_no_more_slots_than_by_single_steps(low, high):
    rng = random.Random(7)
    sizes = []
    while sum(sizes) < 48 * 2048:
        sizes.append(rng.randint(low, high))
    sizes.sort(reverse=True)
    m = -(-sum(sizes) // 2048)
    while np.bincount(packing.differencing(sizes, m), sizes).max() > 2048:
        m += 1
    slots, got = packing.pack_sizes(sizes, 2048)
    assert got <= m and np.bincount(slots, sizes).max() <= 2048


def test_best_fit_is_best():
    rng = random.Random(2)
    sizes = sorted((rng.randrange(1, 65) for _ in range(400)), reverse=True)
    got, room = bin_output.best_fit_decreasing(sizes, 64), {}
    for s, w in zip(sizes, got, strict=True):
        fits = [r for r in room.values() if r >= s]
        assert (min(fits) == room.get(w)) if fits else (w not in room)
        room[w] = room.get(w, 64) - s


def test_packing_round_trip(spark):
    docs = [(i if i else None, t, "s") for i, t in enumerate(texts(40))]
    docs.append(docs[7])
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, text string, length string").repartition(3)).collect()
    want = sorted((d or -1, len(ids_of(t))) for d, t, _ in docs)
    pieces, seen = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seen.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 2048
    by_id = {d: ids_of(t) for d, t, _ in docs}
    repeats = {docs[7][0]: 2}
    total = 0
    for d, parts in pieces.items():
        times = repeats.get(d, 1)
        parts = sorted(parts, key=lambda r: r.start)[::times]
        at = 0
        for r in parts:
            assert r.start == at and r.doc_tokens == len(by_id[d])
            assert r.ids_crc32 == zlib.crc32(np.array(by_id[d][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(by_id[d])
        total += times * at
    assert total == sum(n for _, n in want) and set(pieces) == set(by_id)
    assert len(seen) * 2048 < 1.1 * total + 2048


def test_matrices_round_trip(spark, tmp_path):
    docs = [(i if i else None, t, 1) for i, t in enumerate(texts(30))]
    packed = bin_output.sequences(spark.createDataFrame(docs, "doc_id long, text string, ids int").repartition(3)).cache()
    found = {}
    for r in packed.collect():
        ids, pos = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(pos) == 2048 and r.cu_seqlens[-1] == r.n_tokens and not ids[r.n_tokens :].any()
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            found[d, s] = ids[a:b].tolist()
            assert pos[a:b].tolist() == list(range(b - a))
        assert pos[r.n_tokens :].tolist() == list(range(2048 - r.n_tokens))
    for d, t, _ in docs:
        assert [x for key in sorted((k for k in found if k[0] == d), key=lambda k: k[1]) for x in found[key]] == ids_of(t, PLAIN)
    parts = bin_output.write_matrices(packed, f"file://{tmp_path}/out").collect()
    assert sum(p.rows for p in parts) == packed.count()
    for p in parts:
        assert (tmp_path / "out" / f"{p.part}.ids").stat().st_size == 4096 * p.rows
        assert (tmp_path / "out" / f"{p.part}.cu_seqlens").stat().st_size == 4 * p.cu_length


def test_op3_gives_what_its_files_hold(spark, tmp_path):
    from veldrin.llm import common, queries

    docs = [(i if i else None, t) for i, t in enumerate(texts(30))]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    root = pathlib.Path(common.shared_dir(spark).removeprefix("file:")).resolve()
    before = set(root.rglob("*.ids"))
    got = queries.op3_token_output(spark, str(tmp_path)).collect()
    files = sorted(set(root.rglob("*.ids")) - before)
    assert files and len(got) > 5
    for end, column in (("ids", "ids_crc32"), ("positions", "positions_crc32")):
        rows = [raw[k : k + 4096] for f in files for raw in [f.with_suffix("." + end).read_bytes()] for k in range(0, len(raw), 4096)]
        assert sorted(map(zlib.crc32, rows)) == sorted(r[column] for r in got)
    raw = b"".join(f.with_suffix(".cu_seqlens").read_bytes() for f in files)
    assert sorted(np.frombuffer(raw, "<u4").tolist()) == sorted(x for r in got for x in r.cu_seqlens)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for windows in (512, 1):
        packed = bin_output.sequences(df, windows=windows)
        uri = f"file://{tmp_path}/again{windows}"
        back = bin_output.read_matrices(bin_output.write_indexed(df, uri, windows=windows), uri, rows_at_once=3).collect()
        assert sorted(map(repr, back)) == sorted(map(repr, packed.collect()))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bin_output.write_indexed(empty, f"file://{tmp_path}/none").count() == 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty).count() == 0 and bin_output.sequences(empty).count() == 0


def test_whole_windows_meet_no_group(spark, monkeypatch):
    monkeypatch.setattr(packing, "pack_sizes", None)  # not called: there is nothing but whole windows
    one = "a " * 400
    n = len(ids_of(one))
    docs = [(i, one) for i in range(30)]
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), capacity=n, piece=n).collect()
    assert len(got) == 30 == len({r.sequence_id for r in got}) and all((r.offset, r.length, r.start) == (0, n, 0) for r in got)
