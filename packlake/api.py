"""The library surface: scan, index, rank, pack and export a repository on disk."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlake import dims
from packlake.functions import paths, text
from packlake.functions.redaction import redact, redaction_counts
from packlake.operators import budget, compress, extract, graph, index, rank, render
from packlake.operators.classify import exclusion_label, is_secret_file
from packlake.operators.memory import Notebook, now
from packlake.sources import git_log, stores
from packlake.sources.repo_tree import scan_tree

WORKSPACE = ".packlake"
# The accepted names of formats; the last three are Markdown under another name.
FORMATS = ("markdown", "json", "xml", "claude", "codex")
TEMPLATES = {
    "MEMORY.md": "# Project Memory\n\n## Notes\n\n",
    "DECISIONS.md": "# Decision Log\n\n",
    "CURRENT_TASK.md": "# Current Task\n\n## Task\n\n",
    "PROJECT_INDEX.md": "# Project Index\n\n",
    "CONVENTIONS.md": "# Conventions\n\n",
    "IGNORE": "",
    "CONFIG.json": "{}\n",
    "README.md": "Files of this directory are written by packlake.\n",
}


@dataclass
class Scan:
    """What a scan gave."""

    files: DataFrame
    skipped: DataFrame
    summaries: DataFrame
    edges: DataFrame
    stats: dict = field(default_factory=dict)


class Repository:
    """A repository on disk with the workspace directory its index lives in."""

    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root = spark, Path(root).resolve()
        if not self.root.is_dir():
            raise ValueError(f"not a directory: {root}")
        self.name = self.root.name
        self.workspace = self.root / WORKSPACE
        self.notes = Notebook(self.workspace)

    def init(self, force: bool = False) -> dict[str, str]:
        """Write the templates of a workspace; existing files are kept unless forced. Gives the status of each."""
        self.workspace.mkdir(exist_ok=True)
        out = {}
        for name, body in TEMPLATES.items():
            path = self.workspace / name
            out[name] = "skipped" if path.exists() and not force else "written"
            if out[name] == "written":
                path.write_text(body, encoding="utf-8")
        return out

    def _store(self, name: str) -> str:
        return str(self.workspace / f"{name}.parquet")

    def scan(self, max_files: int | None = None, timestamp: str | None = None) -> Scan:
        """Read the tree, refresh the summaries whose content changed, and write the index, the summaries and the graph."""
        self.workspace.mkdir(exist_ok=True)
        files, skipped = scan_tree(self.spark, str(self.root), max_files=max_files)
        files = files.persist()
        previous = stores.read_or_empty(self.spark, self._store("summaries"), stores.SUMMARY)
        previous = self.spark.createDataFrame(previous.toArrow(), previous.schema)  # it is about to be overwritten
        made = extract.refreshed(files, previous).drop("cached")
        made.write.mode("overwrite").parquet(self._store("summaries"))
        edges = graph.graph_edges(files)
        edges.write.mode("overwrite").parquet(self._store("edges"))
        summaries, edges = self.summaries(), self.edges()
        row = index.repository_index(files, summaries).first()
        if row:
            settings = [r["rel_path"] for r in index.config_files(files).orderBy("rel_path").collect()]
            (self.workspace / "PROJECT_INDEX.md").write_text(render.index_document(row.asDict(), settings, now() if timestamp is None else timestamp), encoding="utf-8")
        size = files.agg(F.sum("size")).first()[0] or 0
        stats = {
            "languages": {r["language"]: r["n_files"] for r in index.language_counts(files).orderBy(F.desc("n_files"), "language").collect()},
            "skipped": {r["reason"]: r["n"] for r in skipped.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy("reason").collect()},
            "n_bytes": size,
            "est_tokens": max(0, int(size / 3.5)),
        }
        return Scan(files, skipped, summaries, edges, stats)

    def scan_report(self, top: int = 5) -> str:
        """A scan as a few lines of text."""
        stats = self.scan().stats
        languages = ", ".join(f"{name} ({n})" for name, n in list(stats["languages"].items())[:top])
        skipped = ", ".join(f"{reason} ({n})" for reason, n in stats["skipped"].items()) or "none"
        return f"Files: {sum(stats['languages'].values()):,}\nLanguages: {languages}\nSkipped: {skipped}\nEstimated tokens: ~{stats['est_tokens']:,}\n"

    def summaries(self) -> DataFrame:
        return stores.read_or_empty(self.spark, self._store("summaries"), stores.SUMMARY)

    def edges(self) -> DataFrame:
        return stores.read_or_empty(self.spark, self._store("edges"), stores.EDGE)

    def _ensure_scan(self) -> None:
        if self.summaries().isEmpty():
            self.scan()

    def _files(self) -> DataFrame:
        return scan_tree(self.spark, str(self.root))[0]

    def keywords(self, task: str) -> list[str]:
        return self.spark.range(1).select(text.keywords(F.lit(task)).alias("k")).first()["k"]

    def rank(self, task: str, include_tests: bool = True, min_score: float = 0.0) -> DataFrame:
        """(repo, rel_path, score, reasons) of every file that may be shown."""
        self._ensure_scan()
        summaries = self.summaries()
        if not include_tests:
            summaries = summaries.where(~paths.is_test(F.col("rel_path")))
        memory = self.notes.memory.read_text(encoding="utf-8") if self.notes.memory.exists() else ""
        mentioned = text.mentioned_paths(F.lit(memory))
        found = self.keywords(task)
        keywords = F.array(*map(F.lit, found)) if found else F.array().cast("array<string>")
        return rank.rank_files(summaries, self.edges(), keywords, git_log.churn_of(self.spark, str(self.root), self.name), mentioned, min_score)

    def select(self, task: str, tokens: int = dims.DEFAULT_BUDGET, include_tests: bool = True, no_source: bool = False, allow_sensitive: bool = False) -> render.Selection:
        """The selection of a task within a budget; rows that reach the driver are bounded by the budget and the excluded paths."""
        if tokens <= 0:
            raise ValueError("the budget must be positive")
        ranking = self.rank(task, include_tests).persist()
        summaries, files = self.summaries(), self._files().select("repo", "rel_path", "content").persist()
        if not include_tests:
            summaries = summaries.where(~paths.is_test(F.col("rel_path")))
        shown = files.where(F.lit(not no_source))
        sized = ranking.join(budget.forms(summaries, shown), ["repo", "rel_path"])
        chosen = budget.select_within(sized, ["repo"], tokens).persist()  # read for texts, warnings, notes and what is left out
        picked = budget.with_texts(chosen, summaries, shown).orderBy("select_no").collect()
        out = render.Selection(task, tokens)
        out.selected = [r.asDict() for r in picked]
        left = ranking.join(chosen.select("rel_path"), "rel_path", "left_anti").orderBy(F.desc("score"), "rel_path").select("rel_path")
        secret = summaries.where(is_secret_file(F.col("rel_path"))).orderBy("rel_path").select("rel_path")
        out.excluded = [{"rel_path": r["rel_path"], "note": r["note"]} for part in (secret, left) for r in part.withColumn("note", exclusion_label(F.col("rel_path"))).collect()]
        if not allow_sensitive:
            held = files.join(chosen.select("rel_path"), "rel_path", "left_semi").select("rel_path", "content", redaction_counts(F.col("content")).alias("whole"))
            lines = held.select("rel_path", "whole", F.posexplode(F.split("content", "\n")).alias("at", "line"))
            found = lines.where(redact(F.col("line")) != F.col("line")).select("rel_path", (F.col("at") + 1).alias("line_no"), F.left(F.trim(redact(F.col("line"))), F.lit(80)).alias("shown"), redaction_counts(F.col("line")).alias("c"))
            rows = found.orderBy("rel_path", "line_no").collect()  # bounded by the budget of the selection
            told = [(r["rel_path"], r["line_no"], name, n, r["shown"]) for r in rows for name, n in r["c"].asDict().items() if n]
            out.warnings = [f"{path}:{line}: {name}: {shown}" for path, line, name, _, shown in told]
            for r in held.select("rel_path", "whole").orderBy("rel_path").collect():  # values of several lines, as key blocks are
                for name, n in r["whole"].asDict().items():
                    if n > sum(m for path, _, other, m, _ in told if (path, other) == (r["rel_path"], name)):
                        out.warnings.append(f"{r['rel_path']}: {name} over several lines")
        notes = graph.dependency_notes(chosen.select("repo", "rel_path"), self.edges()).orderBy("rel_path").limit(render.NOTE_LINES).collect()
        out.notes = [f"- `{r['rel_path']}` {r['note']}" for r in notes]
        out.total_tokens = int(summaries.agg(F.sum(F.col("line_count") * 15)).first()[0] or 0)
        return out

    def _told(self, name: str) -> str:
        path = self.workspace / name
        return path.read_text(encoding="utf-8") if path.exists() else ""

    def pack(self, task: str, tokens: int = dims.DEFAULT_BUDGET, fmt: str = "markdown", compressor: str = "none", timestamp: str | None = "", out: str | None = None, **options) -> str:
        """A rendered pack; always written to the workspace, and to ``out`` where given."""
        if fmt not in FORMATS:
            raise ValueError(f"unknown format {fmt!r}; choose one of: {', '.join(FORMATS)}")
        squeeze = compress.provider(compressor)
        selection = self.select(task, tokens, **options)
        make = render.json_pack if fmt == "json" else render.markdown_pack
        body = make(selection, self._told("PROJECT_INDEX.md"), self._told("DECISIONS.md"), now() if timestamp is None else timestamp, options.get("allow_sensitive", False))
        body = squeeze.compress(body, budget=tokens)
        self.workspace.mkdir(exist_ok=True)
        for path in (self.workspace / ("context_pack.json" if fmt == "json" else "context_pack.md"), *([Path(out)] if out else [])):
            path.write_text(body, encoding="utf-8")
        return body

    def pack_context(self, task: str, tokens: int = dims.DEFAULT_BUDGET, fmt: str = "markdown") -> str:
        """A pack without a timestamp, under a comment that tells what it spares."""
        selection = self.select(task, tokens)
        make = render.json_pack if fmt == "json" else render.markdown_pack
        return render.savings_header(selection) + make(selection, self._told("PROJECT_INDEX.md"), self._told("DECISIONS.md"))

    def export(self, tool: str, task: str, tokens: int = dims.DEFAULT_BUDGET, **options) -> str:
        """The context file of a tool, written to the root."""
        if tool not in render.TOOLS:
            raise ValueError(f"unknown tool {tool!r}; choose one of: {', '.join(render.TOOLS)}")
        made = render.tool_context(render.TOOLS[tool], self.select(task, tokens, **options), self._told("PROJECT_INDEX.md"), self._told("DECISIONS.md"))
        (self.root / render.TOOLS[tool].filename).write_text(made, encoding="utf-8")
        return made

    def list_files(self, task: str, top_n: int = 20) -> str:
        """The first files for a task under a budget that is no limit; files with secret names drop out."""
        rows = rank.top_files(self.rank(task), top_n).orderBy("rank").collect()
        return render.text_table(f"Files for: {task}", [(r["rel_path"], r["score"], "; ".join(r["reasons"]) or "no specific match") for r in rows], "{}  {:.2f}  {}")

    def get_file(self, rel_path: str) -> str:
        """A file's redacted text; paths outside the root and files with secret names are refused."""
        target = (self.root / rel_path).resolve()
        if not target.is_relative_to(self.root):
            raise ValueError("path leads outside the repository")
        if not target.is_file():
            raise FileNotFoundError(rel_path)
        held = self.spark.range(1).select(is_secret_file(F.lit(rel_path)).alias("s"), redact(F.lit(target.read_text(encoding="utf-8", errors="replace"))).alias("t")).first()
        if held["s"]:
            raise PermissionError(f"{rel_path} may hold secrets")
        return held["t"]

    def get_summary(self, rel_path: str) -> dict:
        self._ensure_scan()
        row = self.summaries().where(F.col("rel_path") == rel_path).first()
        if row is None:
            raise KeyError(rel_path)
        return row.asDict()

    def churn_report(self, days: int = git_log.DAYS, top_n: int = 20) -> str:
        rows = git_log.churn_of(self.spark, str(self.root), self.name, days).orderBy(F.desc("commits"), "rel_path").limit(top_n).collect()
        return render.text_table(f"Churn of the last {days} days", [(r["rel_path"], r["commits"]) for r in rows], "{}  {} commits")
