"""Command line: ingest, ask, ingest-items, compact, index-vectors, gen-eval, eval.

    python -m gleaner.cli --store FOLDER ingest TREE
    python -m gleaner.cli --store FOLDER ask "How does Pool.acquire work?"
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import functions as F

from gleaner.engine import Engine
from gleaner.functions.layout import citation
from gleaner.operators import summary
from gleaner.operators.items import BODY_CHARS
from gleaner.plans.retrieve import METHODS
from gleaner.session import session
from gleaner.sources.questions import read_questions, write_questions, write_results


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gleaner", description="Retrieval analytics over text and code, on Spark.")
    p.add_argument("--store", default=os.environ.get("GLEANER_STORE", "gleaner-store"), help="folder of the stored corpus")
    p.add_argument("--shards", type=int, default=None, help="shards of each part of the keyword index, fixed when the store is new; sized by the data if not given")
    sub = p.add_subparsers(dest="command", required=True)

    c = sub.add_parser("ingest", help="chunk a source tree into the store")
    c.add_argument("tree")
    c.add_argument("--reset", action=argparse.BooleanOptionalAction, default=True)

    c = sub.add_parser("ask", help="answer one or more questions")
    c.add_argument("question", nargs="+")
    c.add_argument("--k", type=int, default=6)
    c.add_argument("--method", default="routed", choices=METHODS)
    c.add_argument("--owner", default="owner", help="owner part of links to tracker items")
    c.add_argument("--fallback", action=argparse.BooleanOptionalAction, default=True)

    c = sub.add_parser("ingest-items", help="add closed tracker items from a JSON-lines dump")
    c.add_argument("repo", help="owner/repo")
    c.add_argument("dump")
    c.add_argument("--max-items", type=int, default=None, help="keep those updated last; all if not given")
    c.add_argument("--body-chars", type=int, default=BODY_CHARS, help="characters kept of a body; 0 keeps all")

    c = sub.add_parser("compact", help="merge small generations of the store")
    c.add_argument("--vacuum", action="store_true", help="delete what was replaced; nothing else may use the store meanwhile")

    c = sub.add_parser("index-vectors", help="sort the vectors into cells, for searches that read a part of them")
    c.add_argument("--cells", type=int, default=None)

    c = sub.add_parser("gen-eval", help="write questions about sampled chunks")
    c.add_argument("--n", type=int, default=1000)
    c.add_argument("--output", required=True)
    c.add_argument("--seed", type=int, default=42)

    c = sub.add_parser("eval", help="score retrieval methods on a question set")
    c.add_argument("--questions", required=True)
    c.add_argument("--methods", default="hybrid,vector,bm25")
    c.add_argument("--k", type=int, default=10)
    c.add_argument("--skip-judge", action="store_true")
    c.add_argument("--runs", type=int, default=1)
    c.add_argument("--sample", type=int, default=0)
    c.add_argument("--output-dir", default="results")
    return p


def _ask(engine: Engine, args: argparse.Namespace) -> None:
    answers, hits = engine.ask(engine.questions(*args.question), args.k, args.method, args.fallback)
    label = citation(F.col("source_path"), F.col("start_line"), F.col("end_line"), args.owner)
    shown = hits.where("phase = 'final'").select("qid", "rank", "source", label.alias("label"), "kind", "symbol")
    sources: dict[str, list[str]] = {}
    for hit in shown.orderBy("qid", "rank").collect():
        symbol = f" · {hit['symbol']}" if hit["symbol"] else ""
        sources.setdefault(hit["qid"], []).append(
            f"  [#{hit['rank'] + 1}] {hit['source']} {hit['label']} ({hit['kind']}{symbol})"
        )
    for row in answers.orderBy("qid").collect():
        print(f"{row['question']}\n({row['routed_to'] or args.method})\n\n{row['answer']}\n\nSources:")
        print("\n".join(sources.get(row["qid"], [])) + "\n")


def _eval(engine: Engine, args: argparse.Namespace) -> None:
    methods = [m.strip() for m in args.methods.split(",") if m.strip()]
    facts = engine.evaluate(
        read_questions(engine.spark, args.questions), methods, args.k, args.runs, args.skip_judge, args.sample
    ).cache()
    by_method, by_category = engine.summarize(facts)
    for title, metrics in (("Was the right file found?", summary.PATH_CARD), ("Was the expected chunk found?", summary.STRICT_CARD)):
        print(title)
        summary.printable(summary.scorecard(by_method, metrics), metrics).show(truncate=False)
    print("By category")
    by_category.orderBy("method", "category").show(1000, truncate=False)
    print("Saved", write_results(facts, by_method, by_category, args.output_dir))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    engine = Engine(session(), args.store, shards=args.shards)
    if args.command == "ingest":
        print(f"Stored {engine.ingest(args.tree, args.reset)} chunks.")
    elif args.command == "ask":
        _ask(engine, args)
    elif args.command == "ingest-items":
        added = engine.ingest_items(args.repo, args.dump, args.max_items, args.body_chars or None)
        print(f"Added {added} chunks, {engine.store.count()} in all.")
    elif args.command == "compact":
        merges = engine.store.compact()
        deleted = engine.store.vacuum() if args.vacuum else 0
        print(f"{merges} merges, {deleted} folders deleted.")
    elif args.command == "index-vectors":
        engine.store.index_vectors(args.cells)
        print(f"{engine.store.count()} vectors are in cells.")
    elif args.command == "gen-eval":
        print(f"Wrote {write_questions(engine.generate(args.n, args.seed), args.output)} questions to {args.output}.")
    else:
        _eval(engine, args)


if __name__ == "__main__":
    main()
