from collections import Counter
from hashlib import sha1

import pytest

from palimpsest.llm import op7_warc as w

SCHEMA = "page_id long, url string, html string, digest string, key string, newest int"


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", "k", 1) for i, u, h in rows], SCHEMA)


def test_round_trip(spark):
    big, text = "é<p>" * 400, "x" * 1000
    rows = [(1, "http://a/", big), (5, "http://b/\r\nX: y", big), (3, None, big), (2, "u", "x" * 999), (4, "u", "x" * 999), (None, "u", text), (7, "u", text), (7, "u", text), (8, "", None), (9, "u", "y" * 500_000)]
    rows += [(100 + i, "u", text) for i in range(300)]
    newest = {big: 5, text: 399}
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        target = newest.get(h)
        again = len(raw) >= 1000 and target is not None and i != target
        want[(i, len(raw), sha1(raw).hexdigest(), "revisit" if again else "response", target if again else None)] += 1
    got = Counter(tuple(r) for r in w.round_trip(table(spark, rows).repartition(3)).collect())
    assert got == want
    assert w.round_trip(table(spark, [])).count() == 0


def records():
    return [w.record(str(i), "http://x/", (f"<p>{i}</p>" * 50).encode(), sha1((f"<p>{i}</p>" * 50).encode()).hexdigest(), None) for i in range(30)]


def test_archive_has_a_dictionary_and_a_frame_for_each_record():
    archive = w.write_archive(records())
    assert archive[:4] == bytes.fromhex("5d2a4d18") and list(w.frames(archive)) == records()


@pytest.mark.parametrize("harm", [lambda a: a[4:], lambda a: a[:-3], lambda a: a[:6], lambda a: a[:-40] + bytes([a[-40] ^ 1]) + a[-39:]])
def test_damaged_archives_are_refused(harm):
    with pytest.raises(ValueError):
        [w.parse(c) for c in w.frames(harm(w.write_archive(records())))]


@pytest.mark.parametrize("old,new", [(b"WARC/1.1", b"WARC/0.9"), (b"Content-Length: ", b"Content-Length: 9"), (b"WARC-Date", b"X-Date"), (b"<p>", b"<q>"), (b"WARC-Type: response", b"WARC-Type: metadata")])
def test_damaged_records_are_refused(old, new):
    with pytest.raises(ValueError):
        w.parse(records()[7].replace(old, new, 1))
