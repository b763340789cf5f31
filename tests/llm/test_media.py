import hashlib
import tarfile
import zlib

from gneiss.llm import media
from gneiss.llm.common import Scratch


def test_round_trip(spark, odd, tmp_path):
    text = {r["doc_id"]: r["text"] for r in odd.collect()}
    rows = media.media_columns(odd, f"file://{tmp_path}").collect()
    assert len(rows) == odd.count()
    for r in rows:
        raw = (text[r["doc_id"]] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert (r["width"], r["height"], r["bit_depth"]) == (64, len(payload) // 64, 8)
    for r in rows:  # the payloads are still where the rows say
        png = media.RangeReader().read(r["shard"], r["offset"], r["length"])
        assert hashlib.sha256(png).hexdigest() == r["media_sha256"] and hashlib.sha256(media.from_png(png)).hexdigest() == r["payload_sha256"]
    same = [r for r in rows if r["doc_id"] in (1, 2)]
    assert len({(r["media_sha256"], r["feature"]) for r in same}) == 1


def test_shards_are_tar_files_and_members_are_content_addressed(spark, odd):
    scratch = Scratch(spark, "test-media")
    index = media.store(odd.coalesce(1), scratch, scratch.path("shards"), shard_bytes=2000)
    assert index.select("shard").distinct().count() > 1
    assert index.select("digest").distinct().count() == index.select("shard", "offset").distinct().count()
    for r in index.collect():
        fs, path = media.open_fs(r["shard"])
        with tarfile.open(path) as t:
            member = next(m for m in t.getmembers() if m.name.endswith(f"/{r['digest']}.png"))
            assert (member.offset_data, member.size) == (r["offset"], r["length"])
            assert hashlib.sha256(t.extractfile(member).read()).hexdigest() == r["digest"]


def test_metadata_from_the_header_alone(spark, odd):
    png = media.to_png(b"a" * 640)
    assert media.png_header(png[: media.HEADER_BYTES]) == {"width": 64, "height": 10, "bit_depth": 8, "colour_type": 0}
    assert media.from_png(png) == b"a" * 640


def test_empty(spark, none, tmp_path):
    assert media.media_columns(none, f"file://{tmp_path}").count() == 0
