"""Command line and HTTP routes over a small layer."""

import io
import json
import time
import urllib.request

import datetime as dt
import threading

from claimloom.api import Api, serve
from claimloom.cli import run
from claimloom.operators.store import Store
from tests.test_pipeline import PAGE, claim


def layer(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    texts = {"d1": PAGE, "d2": PAGE.replace("7,356", "7,512"), "d3": PAGE}
    spark.createDataFrame([(d, 1, t) for d, t in texts.items()], "doc_id string, page int, text string").write.parquet(f"{tmp_path}/pages")
    spark.createDataFrame([(d, "Acme Ltd", dt.date(2024, 5, 1), 3) for d in texts], "doc_id string, principal_entity string, published date, fy_end_month int").write.parquet(f"{tmp_path}/docs")
    other = claim(value_raw="₹7,512 Cr", quote="reported revenue of ₹7,512 Cr in FY24")
    for d, c in (("d1", [claim(), claim(quote=None)]), ("d2", [other]), ("d3", [claim()])):
        (folder / f"{d}.json").write_text(json.dumps({"doc_id": d, "batch": 0, "pages": [1], "payload": json.dumps(c)}))
    root = f"file://{tmp_path}/layer"
    out = io.StringIO()
    run(spark, ["--root", root, "ingest", f"file://{folder}", "--pages", f"{tmp_path}/pages", "--documents", f"{tmp_path}/docs"], out)
    store = Store(spark, root)
    store.upsert_documents(spark.createDataFrame([(d, f"{d}.pdf", "T", None, None, 1, d, "ingested", None) for d in texts], "id string, filename string, title string, publisher string, published date, n_pages int, sha256 string, status string, stats string"))
    return store, json.loads(out.getvalue())


def test_surface(spark, tmp_path):
    store, counts = layer(spark, tmp_path)
    assert counts == {"facts": 3, "relations": 3, "failures": 1}
    api = Api(store, ingest=lambda path, progress: progress(1, 1) or {"facts": 0} if "bad" not in path else 1 / 0)
    status, facts = api.handle("GET", "/api/facts?q=REV&limit=2")
    assert (status, facts["total"], len(facts["facts"])) == (200, 3, 2) and facts["facts"][0]["locator"] == "d1#p1" and facts["facts"][0]["period_label"] == "FY2024"
    one = api.handle("GET", f"/api/facts/{facts['facts'][0]['id']}")[1]
    assert one["fact"]["quote"].startswith("reported revenue") and len(one["relations"]) == 2 and one["relations"][0]["confidence"] >= one["relations"][1]["confidence"]
    related = api.handle("GET", "/api/relations?type=contradicts,%20corroborates&limit=1")[1]
    assert related["total"] == 3 and len(related["relations"]) == 1 and related["relations"][0]["type"] == "contradicts"
    assert api.handle("GET", "/api/failures")[1]["summary"] == {"missing_quote": 1}
    assert api.handle("GET", "/api/measures")[1]["measures"][0]["surface_forms"] == {"revenue": 3}
    assert api.handle("GET", "/api/stats")[1]["relations_by_type"] == {"contradicts": 2, "corroborates": 1}
    assert api.handle("POST", "/api/relink")[1] == {"relations_written": 3, "by_type": {"contradicts": 2, "corroborates": 1}}
    assert [api.handle("GET", p)[0] for p in ("/api/facts/none", "/api/jobs/none", "/other", "/api/facts?limit=x")] == [404, 404, 404, 400]
    assert api.handle("POST", "/api/documents?path=a.txt")[0] == 400
    for path, want in (("a.pdf", "done"), ("bad.pdf", "error")):
        job = api.handle("POST", f"/api/documents?path={path}")[1]["job_id"]
        for _ in range(50):
            if (state := api.handle("GET", f"/api/jobs/{job}")[1])["status"] != "running":
                break
            time.sleep(0.05)
        assert state["status"] == want
    out = io.StringIO()
    for argv in (["show", "--type", "contradicts", "--limit", "1"], ["stats"], ["link"], ["link", "--rebuild"]):
        run(spark, ["--root", store.root, *argv], out)
    assert "CONTRADICTS / value_divergence" in out.getvalue() and '"pairs_skipped_existing": 3' in out.getvalue()
    server = serve(api, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    assert json.loads(urllib.request.urlopen(f"{base}/healthz").read()) == {"ok": True}
    assert b"<h1>" in urllib.request.urlopen(base + "/").read()
    server.shutdown()
    assert api.handle("DELETE", "/api/documents/d2")[1] == {"deleted": "d2"} and api.handle("DELETE", "/api/documents/d2")[0] == 404
    assert len(api.handle("GET", "/api/documents")[1]["documents"]) == 2 and api.handle("GET", "/api/relations")[1]["total"] == 1


def test_appends_write_new_rows_only(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/layer")
    row = lambda i: (f"f{i}", i)
    for i in range(4):
        s.add_facts(spark.createDataFrame([row(i), row(0)], "id string, v int"))
    assert s.version("facts") == 1 and s._batches("facts", 1) == [0, 1, 2, 3] and s.read("facts").count() == 4
    assert spark.read.parquet(f"{s.root}/facts/v=1/b=2").count() == 1
    s.MOST_BATCHES = 4
    s.add_facts(spark.createDataFrame([row(9)], "id string, v int"))
    assert s.version("facts") == 2 and s._batches("facts", 2) == [0] and s.read("facts").count() == 5
