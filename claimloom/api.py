"""The layer's HTTP surface: each route is a DataFrame, and what is sent is its rows as JSON."""

from __future__ import annotations

import json
import re
import threading
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import registry, views
from .operators.store import Store

_PAGE = """<!doctype html><title>claimloom</title><h1>claimloom</h1><nav>%s</nav><pre id=out></pre>
<script>async function show(p){out.textContent=JSON.stringify(await (await fetch(p)).json(),null,1)}</script>"""
_TABS = {"relations": "/api/relations?limit=300", "facts": "/api/facts?limit=400", "documents": "/api/documents", "measures": "/api/measures", "failures": "/api/failures?limit=300", "stats": "/api/stats"}


class Missing(LookupError):
    """What was asked for is not there."""


def rows(df: DataFrame, limit: int | None = None) -> list[dict]:
    """Rows as plain values; dates as ISO text. Lists are limited before they reach the driver."""
    shown = df.limit(limit) if limit else df
    return [json.loads(r["json"]) for r in views.as_json(shown).collect()]


class Api:
    """Routes over a store. ``ingest`` takes a landed file and a report function and does the work of an upload."""

    def __init__(self, store: Store, ingest: Callable[[str, Callable[[int, int], None]], dict] | None = None):
        self.store, self.ingest = store, ingest
        self.jobs: dict[str, dict] = {}
        self._lock = threading.Lock()

    def _table(self, name: str) -> DataFrame:
        df = self.store.read(name)
        if df is None:
            raise Missing(f"no {name} yet")
        return df

    def documents(self) -> dict:
        d = self._table("documents")
        shown = [c for c in ("id", "filename", "title", "publisher", "published", "n_pages", "status", "stats") if c in d.columns]
        return {"documents": rows(d.orderBy(*[c for c in ("ingested_at", "id") if c in d.columns]).select(*shown))}

    def facts(self, doc_id=None, measure_key=None, q=None, limit=500) -> dict:
        f = self._table("facts")
        found = views.search(f, doc_id, measure_key, q)
        labels = registry.measures(f).select(F.col("key").alias("measure_key"), F.col("label").alias("measure_label"))
        top = found.orderBy("doc_id", "page", "id").limit(int(limit))
        return {"total": found.count(), "facts": rows(views.fact_rows(top, labels))}

    def fact(self, fact_id: str) -> dict:
        found = rows(views.one_fact(self._table("facts"), self._relations(), fact_id))
        if not found:
            raise Missing("unknown fact")
        return {"fact": found[0]["fact"], "relations": [r["relation"] for r in found if r.get("relation")]}

    def _relations(self) -> DataFrame:
        return self._table("relations")

    def relations(self, type=None, cross_document_only="false", limit=200) -> dict:  # noqa: A002
        found = rows(views.list_relations(self._relations(), self._table("facts"), type, str(cross_document_only).lower() in ("1", "true", "yes"), int(limit)))
        return {"total": found[0]["total"] if found else 0, "relations": [{k: v for k, v in r.items() if k != "total"} for r in found]}

    def failures(self, doc_id=None, limit=200) -> dict:
        f = self._table("failures")
        return {"summary": {r["kind"]: r["n"] for r in views.failure_summary(f).collect()}, "failures": rows(views.list_failures(f, doc_id, int(limit)))}

    def measures(self) -> dict:
        found = rows(registry.measures_in_full(self._table("facts")))
        return {"total": len(found), "measures": found}

    def stats(self) -> dict:
        return rows(views.layer_stats(*(self._table(n) for n in ("documents", "facts", "relations", "failures"))))[0]

    def relink(self) -> dict:
        made = self.store.relink()
        by_type = {r["type"]: r["n"] for r in views.relations_by_type(made).collect()}
        return {"relations_written": sum(by_type.values()), "by_type": by_type}

    def delete(self, doc_id: str) -> dict:
        if self._table("documents").where(F.col("id") == doc_id).isEmpty():
            raise Missing("unknown document")
        self.store.delete_document(doc_id)
        return {"deleted": doc_id}

    def upload(self, path: str) -> dict:
        """Start the ingest of a landed file in the background and return its job."""
        if not path.lower().endswith((".pdf", ".json")):
            raise ValueError("only PDF files and landed answers are taken")
        if self.ingest is None:
            raise ValueError("no ingest is configured")
        job = {"id": uuid.uuid4().hex[:12], "filename": path.rpartition("/")[2], "status": "running", "started_at": datetime.now(UTC).isoformat(), "progress": {"done": 0, "total": 0}}
        with self._lock:
            self.jobs[job["id"]] = job
        threading.Thread(target=self._run, args=(job["id"], path), daemon=True).start()
        return {"job_id": job["id"]}

    def _run(self, job_id: str, path: str) -> None:
        def progress(done: int, total: int) -> None:
            with self._lock:
                self.jobs[job_id]["progress"] = {"done": done, "total": total}

        try:
            outcome = {"status": "done", "report": self.ingest(path, progress)}
        except Exception as e:  # noqa: BLE001 - a failed job is a state, not a crash
            outcome = {"status": "error", "error": f"{type(e).__name__}: {e}"}
        with self._lock:
            self.jobs[job_id].update(outcome)

    def job(self, job_id: str) -> dict:
        with self._lock:
            if job_id not in self.jobs:
                raise Missing("unknown job")
            return dict(self.jobs[job_id])

    def handle(self, method: str, target: str) -> tuple[int, object]:
        """Status and body of a request; a text body is HTML."""
        url = urlsplit(target)
        asked = {k: v[-1] for k, v in parse_qs(url.query).items()}
        routes: list[tuple[str, str, Callable]] = [
            ("GET", "/", lambda: _PAGE % " ".join(f"<a href=\"#\" onclick=\"show('{p}')\">{n}</a>" for n, p in _TABS.items())), ("GET", "/healthz", lambda: {"ok": True}), ("GET", "/api/documents", self.documents), ("POST", "/api/documents", self.upload),
            ("DELETE", "/api/documents/(?P<doc_id>[^/]+)", self.delete), ("GET", "/api/jobs/(?P<job_id>[^/]+)", self.job), ("GET", "/api/facts", self.facts), ("GET", "/api/facts/(?P<fact_id>[^/]+)", self.fact), ("GET", "/api/relations", self.relations),
            ("GET", "/api/failures", self.failures), ("GET", "/api/measures", self.measures), ("GET", "/api/stats", self.stats), ("POST", "/api/relink", self.relink),
        ]
        for verb, pattern, action in routes:
            if verb == method and (m := re.fullmatch(pattern, url.path)):
                try:
                    return 200, action(**asked, **m.groupdict())
                except Missing as e:
                    return 404, {"detail": str(e)}
                except (TypeError, ValueError) as e:
                    return 400, {"detail": str(e)}
        return 404, {"detail": "no such route"}


def serve(api: Api, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server of ``api``; the caller runs ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            status, body = api.handle(self.command, self.path)
            data = body.encode() if isinstance(body, str) else json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/html" if isinstance(body, str) else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _answer

        def log_message(self, *args) -> None:
            return

    return ThreadingHTTPServer((host, port), Handler)
