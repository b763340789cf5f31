"""Alignment by the book: whole texts, places where both end, every pair."""

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer


def by_hand(rows):
    """Sorted (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of rows (doc_id, text)."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    out, held = [], Counter()
    for doc_id, text in rows:
        a = b = []
        if text:
            e = t.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(alphabet[c] for c in t.id_to_token(i))) for i in e.ids]
            b = [(i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()) for i in sp.encode(text) for p in [sp.id_to_piece(i)]]
            want = (" " + text).encode()
            if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
                a = b = []
        ends = []
        for side in (a, b):
            at, found = 0, []
            for _, x in side:
                at += len(x)
                found.append(at)
            ends.append(found)
        both = set(ends[0]) & set(ends[1])

        def grouped(side, found):
            out, now = [], []
            for (i, _), at in zip(side, found):
                now.append(i)
                if at in both:
                    out.append(now)
                    now = []
            return out

        groups = list(zip(grouped(a, ends[0]), grouped(b, ends[1])))
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        held.update(links.keys())
        digest = hashlib.sha256(";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups).encode()).hexdigest() if a else ""
        out.append((doc_id, len(a), len(b), len(groups), links, digest))
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    return sorted(
        ((d, na, nb, ng, sum(links.values()), sum(n for p, n in links.items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in links.items()), sha) for d, na, nb, ng, links, sha in out),
        key=lambda r: tuple((v is not None, v) for v in r),
    )
