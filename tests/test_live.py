import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from lantern.sources import landed, live

ITEM = "<item><title>{0}</title><description>d</description><link>http://x/{0}</link><pubDate>{1}</pubDate></item>"


def write(path, *items):
    path.write_text("<rss><channel>" + "".join(ITEM.format(*i) for i in items) + "</channel></rss>")


def test_a_live_feed_gives_each_entry_once_and_again_when_replayed(spark, tmp_path):
    spark.dataSource.register(live.LiveFeeds)
    one, two, out = tmp_path / "one.xml", tmp_path / "two.xml", str(tmp_path / "out")
    early = [("a", "Mon, 01 Jan 2024 00:00:00 GMT"), ("b", "2024-01-01T01:00:00Z"), ("odd", "yesterday"), ("c", "Mon, 01 Jan 2024 05:00:00 +0200")]
    write(one, *early)
    write(two, ("d", "Mon, 01 Jan 2024 02:00:00 GMT"))
    places = "\n".join([one.as_uri(), two.as_uri(), (tmp_path / "none.xml").as_uri()])

    def run(until):
        rows = spark.readStream.format("lantern_live").option("names", "one\ntwo\nnone").option("places", places).option("until", until).option("budget", 2).option("pause", 0).load()

        def keep(batch, n):
            batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

        query = rows.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()

    def links():
        return sorted(r.link for r in spark.read.parquet(out).collect() if r.status == "ok")

    run(1704069000)  # half past midnight
    assert links() == ["http://x/a"]
    write(one, *early, ("late", "Mon, 01 Jan 2024 02:30:00 GMT"))
    run(1704078000)  # three o'clock
    assert links() == [f"http://x/{n}" for n in ("a", "b", "c", "d", "late")]
    failed = [r for r in spark.read.parquet(out).collect() if r.status != "ok"]
    assert {(r.source, r.status) for r in failed} == {("none", "error:download:URLError")}
    commits = sorted((tmp_path / "c" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()  # as after a failure before the last commit
    for crc in (tmp_path / "c" / "commits").glob(f".{commits[-1].name}.crc"):
        crc.unlink()
    run(1704078000)
    assert links() == [f"http://x/{n}" for n in ("a", "b", "c", "d", "late")]


class Server(BaseHTTPRequestHandler):
    tokens, uses, seen = 0, 0, []

    def reply(self, code, body):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(body)

    def do_POST(self):  # noqa: N802
        assert self.headers["Authorization"] == "Basic aWQ6c2VjcmV0"
        assert self.rfile.read(int(self.headers["Content-Length"])) == b"grant_type=client_credentials"
        Server.tokens, Server.uses = Server.tokens + 1, 0
        self.reply(200, json.dumps({"access_token": f"t{Server.tokens}", "expires_in": 3600}).encode())

    def do_GET(self):  # noqa: N802
        Server.uses += 1
        good = self.headers["Authorization"] == f"Bearer t{Server.tokens}" and Server.uses <= 3  # a token is refused after three requests
        Server.seen.append(good)
        self.reply(200 if good and self.path != "/gone" else 404 if good else 401, self.path.encode())

    def log_message(self, *_):
        pass


def test_a_token_is_renewed_in_the_middle(spark):
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    session = live.TokenSession(f"{base}/token", "id", "secret", "test")
    requests = spark.createDataFrame([(f"{base}/{n}",) for n in ("a", "b", "gone", "c", "d", "e", "f")], "url string").coalesce(1)
    got = [(r.value, r.status) for r in landed.responses(requests, session).collect()]
    server.shutdown()
    assert got == [("/a", "ok"), ("/b", "ok"), (None, "error:download:HTTPError"), ("/c", "ok"), ("/d", "ok"), ("/e", "ok"), ("/f", "ok")]
    assert Server.tokens == 3 and Server.seen.count(False) == 2
    with pytest.raises(ValueError, match="are needed"):
        live.TokenSession(base, "", "x", "test")


def test_dates_of_feeds():
    assert live.dated("Mon, 01 Jan 2024 00:00:00 GMT") == live.dated("2024-01-01T00:00:00") == live.dated("2024-01-01T02:00:00+02:00") == 1704067200
    assert live.dated("soon") is live.dated("") is live.dated(None) is None
