"""The corpus as an object: search, single papers and related ones as plain dictionaries."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from lexigrid.operators import search as s
from lexigrid.operators.quality import require_same_ids, require_unique


# How results name their relation to the question.
METHOD, UNCLUSTERED, SAME_LEAF = "lexical", "unclustered", "same_leaf_cluster; newest first, not similarity-ranked"


class Corpus:
    """One snapshot; its tables are checked once and kept."""

    def __init__(self, papers: DataFrame, assignments: DataFrame, labels: DataFrame):
        """papers; assignments (paper_id, leaf); labels (cluster_id, label)."""
        require_unique(papers, "paper_id")
        require_unique(assignments, "paper_id")
        require_same_ids(papers, assignments, "paper_id")
        self.papers, self.assignments, self.labels = papers.cache(), assignments.cache(), labels

    def search_papers(self, query: str, venue: str | None = None, year: int | None = None, limit: int = 10) -> dict[str, Any]:
        rows = [r.asDict(True) for r in s.search(self.papers, query, venue, year, limit, strict=True).collect()]  # at most 50
        total = rows[0]["total_matches"] if rows else 0
        keep = [{k: v for k, v in r.items() if k not in ("score", "total_matches")} for r in rows]
        return {"query": query, "search_method": METHOD, "total_matches": total, "papers": keep, "evidence_scope": s.EVIDENCE}

    def get_paper(self, paper_id: str) -> dict[str, Any]:
        row = s.get_paper(self.papers, self.assignments, self.labels, paper_id).first()
        if row is None:
            raise LookupError(f"unknown paper_id: {paper_id}")
        return row.asDict(True)

    def related_papers(self, paper_id: str, limit: int = 10) -> dict[str, Any]:
        s.check_limit(limit)
        cluster = self.get_paper(paper_id)["leaf_cluster"]
        out: dict[str, Any] = {"paper_id": paper_id, "evidence_scope": s.EVIDENCE}
        if cluster is None:
            return out | {"relationship": UNCLUSTERED, "papers": []}
        rows = [r.asDict(True) for r in s.related(self.papers, self.assignments, paper_id, limit).collect()]  # at most 50
        keep = [{k: v for k, v in r.items() if k not in ("leaf", "total_cluster_peers")} for r in rows]
        return out | {"relationship": SAME_LEAF, "leaf_cluster": cluster, "total_cluster_peers": rows[0]["total_cluster_peers"] if rows else 0, "papers": keep}
