"""A shell: ``search words --type=component --rerank``, ``view 2``, ``exit``.

    python -m sparkloom.plans.cli PROJECT DATA [--reload] [--search-only]
"""

from __future__ import annotations

import argparse
import cmd

from pyspark.sql import SparkSession

from ..sources.project import parse_command
from .engine import Engine


def hit_lines(rows: list[dict]) -> list[str]:
    out = []
    for i, r in enumerate(rows, 1):
        cross = f" | rerank {r['cross_score']:.4f}" if r.get("cross_score") is not None else ""
        out += [f"[{i}] {r['name']} ({r['type']}) - score {r['score']:.4f}{cross}", f"  {r['file_name']}", f"  {r['content_preview']}"]
    return out


class Shell(cmd.Cmd):
    prompt = "> "

    def __init__(self, engine: Engine, **kwargs):
        super().__init__(**kwargs)
        self.engine, self.results = engine, []

    def do_search(self, arg: str) -> None:
        if not arg.strip():
            print("search for what?", file=self.stdout)
            return
        try:
            self.results = [r.asDict() for r in self.engine.search(parse_command(arg)).collect()]
        except ValueError as e:
            print(e, file=self.stdout)
            return
        print("\n".join(hit_lines(self.results)) or "nothing found", file=self.stdout)

    def do_view(self, arg: str) -> None:
        if not self.results:
            print("search first", file=self.stdout)
        elif not arg.strip().isdigit() or not 1 <= int(arg) <= len(self.results):
            print(f"a number from 1 to {len(self.results)}", file=self.stdout)
        else:
            r = self.results[int(arg) - 1]
            whole = self.engine.fragment(r["id"])
            print("\n".join([*hit_lines([r]), whole["file_path"], *([f"props: {', '.join(whole['props'])}"] if whole["props"] else [])]), file=self.stdout)

    def do_exit(self, arg: str) -> bool:
        return True

    do_quit = do_exit


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("project")
    p.add_argument("data")
    p.add_argument("--reload", action="store_true")
    p.add_argument("--search-only", action="store_true")
    a = p.parse_args(argv)
    engine = Engine(SparkSession.builder.appName("sparkloom").getOrCreate(), a.data)
    if not a.search_only and (a.reload or engine.store.is_empty()):
        engine.index(a.project, a.reload)
    Shell(engine).cmdloop()


if __name__ == "__main__":
    main()
