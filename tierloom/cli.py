"""python -m tierloom.cli audit | compress | search | replay | verify | synth | bench | serve ..."""

from __future__ import annotations

import argparse
import json
import sys
import time

from tierloom.errors import TierError
from tierloom.session import session


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tierloom")
    sub = p.add_subparsers(dest="command", required=True)
    commands = {
        "audit": ("path", "store"), "compress": ("path", "store", "tier"), "search": ("store", "query"), "replay": ("store", "trace_id"), "verify": ("store",),
        "synth": ("path",), "bench": ("sf_dir",), "serve": ("store", "root"),
    }
    for name, more in commands.items():
        s = sub.add_parser(name)
        for m in more:
            s.add_argument(m)
        if name == "audit":
            s.add_argument("--report")
            s.add_argument("--prices")
        if name == "search":
            s.add_argument("--k", type=int, default=10)
            s.add_argument("--tier")
        if name == "synth":
            s.add_argument("--gb", type=float, default=0.01)
            s.add_argument("--vectors", type=int, default=5000)
        if name == "bench":
            s.add_argument("--query", action="append")
        if name == "serve":
            s.add_argument("--port", type=int, default=8080)
    a = p.parse_args(args)
    import tierloom
    from tierloom.plans.store import Store

    spark = session()
    try:
        if a.command == "audit":
            print(tierloom.audit(spark, a.path, a.store, a.report, prices=a.prices).text())
        elif a.command == "compress":
            print(json.dumps(_compress(spark, a.path, a.store, a.tier)))
        elif a.command == "search":
            for r in Store(spark, a.store, create=False).search_cli(a.query, a.k, a.tier).orderBy("query", "rank").collect():
                print(r["rank"], r["id"], f"{r['score']:.6f}")
        elif a.command == "replay":
            for line in Store(spark, a.store, create=False).replay_raw(a.trace_id):
                sys.stdout.buffer.write(line + b"\n")
        elif a.command == "synth":
            print(json.dumps(tierloom.synth(spark, a.path, a.gb, vectors=a.vectors)))
        elif a.command == "bench":
            print(json.dumps(_bench(spark, a.sf_dir, a.query)))
        elif a.command == "serve":
            from tierloom.service import serve

            serve(spark, a.store, a.root, port=a.port).serve_forever()
        else:
            bad = Store(spark, a.store, create=False).verify()
            print("\n".join(bad) or "all files are as they were written")
            return int(bool(bad))
    except TierError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


def _compress(spark, path: str, store: str, tier: str) -> dict:
    """Traces and vectors of a corpus, as far as it has them and the tier takes them."""
    from tierloom.plans.store import Store
    from tierloom.sources.corpus import locate

    corpus, out = locate(path), {}
    with Store(spark, store) as s:
        if corpus.traces and tier != "hot":
            out["traces"] = s.put_traces(corpus.traces, tier)
        if corpus.vectors:
            out["vectors"] = s.put_embeddings(corpus.vectors, tier)
    return out


def _bench(spark, sf_dir: str, names: list[str] | None) -> dict:
    """Seconds of the catalogue's queries, or of those named."""
    from tierloom.plans import catalog

    took = {}
    for name in names or sorted(catalog.queries()):
        began = time.time()
        catalog.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    return took


if __name__ == "__main__":
    sys.exit(main())
