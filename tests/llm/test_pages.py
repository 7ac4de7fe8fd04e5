"""WARC and URL operators over pages."""

import base64
import hashlib
import io
import re
from collections import Counter

import pytest

from musterline.llm import url_filter, warc

PAGE = "page_id long, url string, html string, payload string"


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "né " * 100_000
    rows = [
        (5, "http://a.example/", "<b>same</b>"),
        (2, "http://a.example/x y\n", "<b>same</b>"),
        (9, None, "<b>same</b>"),
        (9, None, "<b>same</b>"),
        (3, "", None),
        (4, "u", ""),
        (None, "v", "only here"),
        (None, "v", "<b>same</b>"),
        (7, "w", big),
        (8, "w", "a\r\n\r\nb"),
    ]
    return spark.createDataFrame([(*r, "clash") for r in rows], PAGE)


def plain_records(rows, least):
    first = {}
    for r in rows:
        if r["page_id"] is not None:
            html = r["html"] or ""
            first[html] = min(first.get(html, r["page_id"]), r["page_id"])
    out = []
    for r in rows:
        body = (r["html"] or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        to = first.get(r["html"] or "")
        revisit = len(body) >= least and to is not None and to != r["page_id"]
        out.append(
            (r["page_id"], len(body), digest, "revisit" if revisit else "response", to if revisit else None)
        )
    return Counter(out)


@pytest.mark.parametrize("least", [0, 5, 1000])
def test_round_trip_equals_brute_force(spark, pages, least):
    got = warc.round_trip(spark, pages, least).collect()
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(tuple(r[n] for n in names) for r in got) == plain_records(pages.collect(), least)
    stored = {r["payload_digest"]: r["payload"] for r in got if r["record_type"] == "response"}
    for r in got:
        content = stored[r["payload_digest"]]
        assert len(content) == r["payload_bytes"] and warc.base32_sha1(bytes(content)) == r["payload_digest"]


def test_archives_are_split_by_size(spark, pages, tmp_path):
    rows = warc.with_first(pages).coalesce(1)
    archives = warc.write(rows, str(tmp_path), archive_bytes=300)
    assert archives.count() > 2
    assert warc.read(archives, str(tmp_path)).count() == pages.count()


def test_members_are_ordinary_gzip():
    import gzip

    packed = warc.record(1, "http://x/", b"hello", None) + warc.record(2, None, b"", None)
    plain = gzip.decompress(packed)
    assert plain.count(b"WARC/1.1\r\n") == 2 and plain.endswith(b"\r\n\r\n\r\n\r\n")


def test_damage_is_reported():
    good = warc.record(1, "http://x/", b"hello" * 100, None)
    assert len(list(warc.read_records(io.BytesIO(good * 3)))) == 3
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(good[:-20])))
    import gzip

    plain = gzip.decompress(good)
    for wrong in (
        plain.replace(b"hellohello", b"jellohello", 1),
        plain.replace(b"hellohello", b"hello", 1),
        plain[:-4],
    ):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(gzip.compress(wrong))))


def foreign(head, block, version="WARC/1.0"):
    import gzip

    fields = "".join(f"{line}\r\n" for line in [version, *head, f"content-length: {len(block)}"])
    return gzip.compress(fields.encode() + b"\r\n" + block + b"\r\n\r\n")


def test_archives_of_other_writers(spark, tmp_path):
    body = b"hello wide world"
    chunked = b"5;x=1\r\nhello\r\nb\r\n wide world\r\n0\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nX-Long: a\r\n  folded\r\nTransfer-Encoding: Chunked\r\n\r\n"
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    hexed = lambda kind, b: hashlib.new(kind, b).hexdigest()
    uuid = "<urn:uuid:0b3f5a1c-0000-4000-8000-00000000000%d>"
    of_http = "Content-Type: application/http;msgtype=response"
    archive = b"".join(
        [
            foreign(["WARC-Type: warcinfo", "WARC-Record-ID: " + uuid % 1, "Content-Type: application/warc-fields"], b"software: x\r\n"),
            foreign(["warc-type: request", "warc-record-id: " + uuid % 2], b"GET / HTTP/1.1\r\n\r\n", "WARC/0.18"),
            foreign(["WARC-TYPE: response", "WARC-Target-URI: <http://x/\r\n   y>", of_http,
                     "WARC-Payload-Digest: SHA-256:" + hexed("sha256", body), "WARC-Block-Digest: md5:" + hexed("md5", http + chunked)], http + chunked, "WARC/1.1"),
            foreign(["WARC-Type: response", of_http, "WARC-Payload-Digest: sha1:" + sha(chunked)], http + chunked),
            foreign(["WARC-Type: response", of_http, "WARC-Payload-Digest: blake3:zz"], b"HTTP/1.0 200\r\n\r\n" + body),
            foreign(["WARC-Type: response", "Content-Type: text/dns"], b"x. 1 IN A 1.2.3.4"),
            foreign(["WARC-Type: revisit", of_http, "WARC-Refers-To: " + uuid % 2, "WARC-Payload-Digest: sha1:ABC"], b"HTTP/1.1 304\r\n\r\n"),
            foreign(["WARC-Type: metadata"], b""),
        ]
    )
    rows = list(warc.read_records(io.BytesIO(archive)))
    assert [r["record_type"] for r in rows] == "warcinfo request response response response response revisit metadata".split()
    assert [r["payload"] for r in rows[2:5]] == [body] * 3 and rows[2]["payload_digest"] == sha(body)
    assert rows[2]["url"] == "http://x/ y" and rows[0]["record_id"] == uuid % 1
    assert rows[6]["refers_to_id"] == uuid % 2 and rows[6]["payload_bytes"] is None and rows[6]["payload"] is None
    assert rows[5]["payload"] == b"x. 1 IN A 1.2.3.4" and rows[7]["payload_bytes"] == 0
    assert all(r["page_id"] is None and r["refers_to"] is None for r in rows)
    # The same by Spark, without payloads, and wrong digests are found in every form.
    (tmp_path / "a.warc.gz").write_bytes(archive)
    names = spark.createDataFrame([("a.warc.gz",)], "archive string")
    back = warc.read(names, str(tmp_path), with_payload=False).collect()
    assert [r["payload_bytes"] for r in back] == [r["payload_bytes"] for r in rows]
    for wrong in ("WARC-Payload-Digest: sha256:" + hexed("sha256", b"else"), "WARC-Block-Digest: md5:" + hexed("md5", b"else")):
        with pytest.raises(ValueError, match="digest differs"):
            list(warc.read_records(io.BytesIO(foreign(["WARC-Type: response", of_http, wrong], http + chunked))))
    with pytest.raises(ValueError, match="not a record"):
        list(warc.read_records(io.BytesIO(foreign([], b"", "HTTP/1.1 200"))))


def test_chunks_in_pieces_of_any_size():
    text = b"".join(b"%x\r\n%s\r\n" % (n, b"z" * n) for n in (1, 15, 16, 300)) + b"0\r\n\r\n"
    for size in (1, 2, 3, 7, 1000):
        chunks = warc.Chunks()
        out = b"".join(chunks.feed(text[i : i + size]) for i in range(0, len(text), size))
        assert out == b"z" * 332 and chunks.sound and chunks.ended


def test_hot_payloads_are_split(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "SPLIT_ROWS", 1)
    got = warc.with_first(pages).collect()
    assert Counter((r["page_id"], r["first"]) for r in got)[(9, 2)] == 2 and len(got) == pages.count()


URLS = [
    "http://x.com/a",
    "https://Example.COM/en/1",
    "https://www.example.com/en/1?x=http://q.net/es/",
    "http://a.example.com/EN/1",
    "http://badexample.com/en/",
    "http://q.net/es/1",
    "http://net/fr/",
    "http://q.net/en/1",
    "http://x.com",
    "x.com/a",
    None,
    "",
    "://",
    "http://u:p@h.org:80/ü?a#b",
    "http://h.org#/es/",
] * 3


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        own + start
        for _, own, start in url_filter.RULES
        if (host == own or host.endswith("." + own)) and path.startswith(start)
    ]
    return host, path, max(fits, key=len, default=None)


def test_hosts_paths_and_rules(spark):
    frame = spark.createDataFrame(
        [(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, symbols string"
    )
    got = {r["page_id"]: r for r in url_filter.judge(frame).collect()}
    verdicts = {own + start: verdict for verdict, own, start in url_filter.RULES}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, rule = plain_rule(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == (verdicts[rule] if rule else got[i]["verdict"])


def test_models_tell_kinds_apart(spark):
    rows = [(i, f"http://site{i % 50}.com/news/{i}") for i in range(300)]
    rows += [(1000 + i, f"http://q{i % 50}.net/es/casino-{i}") for i in range(300)]
    rows += [(5000, "http://a.org/news/1"), (5001, "http://q1.org/es/casino-2")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"))
    verdict = {r["page_id"]: r["verdict"] for r in got.where("page_id >= 5000").collect()}
    assert verdict == {5000: "allow", 5001: "block"}


def test_the_cut_has_the_least_error():
    assert url_filter.cut_of([]) == 0.0
    assert url_filter.cut_of([(-3, 0, 5), (2, 5, 0)]) == 0.0
    assert url_filter.cut_of([(5, 0, 5), (9, 5, 0)]) == pytest.approx(0.09)


SCRIPTS = [f"https://{h}.{top}/{p}" for h, top, p in [
    ("пример", "com", "страница/один"), ("пример", "net", "fr/две"), ("例子", "net", "es/文章"),
    ("例子", "com", "文章一"), ("a1", "com", "x9"), ("a2", "net", "fr/x8"), ("📚📖", "net", "es/📚"),
] for _ in range(1)]


def test_urls_in_any_script_equal_the_sql(spark, tmp_path, monkeypatch):
    import duckdb

    from musterline.llm import oracles
    from musterline.llm.queries import op9_urls

    own = SCRIPTS + [u + str(i) for i in range(30) for u in SCRIPTS]
    own += ["http://другой.рф/путь", "http://别的.中国/路径", "http://xx.org/ab", None, "", "no address"] * 2
    own += ["http://same.org/"] * 300
    rows = [(i, u, "", 1) for i, u in enumerate(own)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, `a.b` int")
    frame.write.parquet(f"{tmp_path}/pages.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    cursor = connection.execute(oracles.URLS)
    names = [c[0] for c in cursor.description]
    theirs = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(r)) for r in op9_urls(spark, str(tmp_path)).select(*names).collect()) == theirs
    # The way for large tables, with hot grams and addresses split.
    monkeypatch.setattr(url_filter, "BROADCAST_GRAMS", 0)
    monkeypatch.setattr(url_filter, "SPLIT_ROWS", 20)
    assert sorted(repr(tuple(r)) for r in op9_urls(spark, str(tmp_path)).select(*names).collect()) == theirs
    scores = {r["page_id"]: r["score"] for r in url_filter.judge(frame).collect()}
    left = [scores[i] for i, u in enumerate(own) if u in ("http://другой.рф/путь", "http://别的.中国/路径", "http://xx.org/ab")]
    assert len(set(left)) == 3
