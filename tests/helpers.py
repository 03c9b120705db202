"""Tiny tables for tests."""

from __future__ import annotations

import hashlib
import random

from lodeseek import schemas
from lodeseek.plans.indexing import Sources
from lodeseek.settings import DEFAULT_REF_REGEX

MASTER, DEVELOP, TOPIC = "refs/heads/master", "refs/heads/develop", "refs/heads/topic"


def sha(text: str) -> str:
    return hashlib.sha1(text.encode()).hexdigest()


class World:
    """Repositories in plain Python: ref -> {path: content} and ref -> {commit subject}."""

    def __init__(self) -> None:
        self.trees: dict[tuple[str, str, str], dict[str, bytes]] = {}
        self.histories: dict[tuple[str, str, str], set[str]] = {}
        self.regex: dict[tuple[str, str], str] = {}

    def set(self, project: str, repository: str, ref: str, tree: dict[str, bytes], history: set[str]) -> None:
        self.trees[project, repository, ref] = tree
        self.histories[project, repository, ref] = history

    def drop(self, project: str, repository: str, ref: str) -> None:
        del self.trees[project, repository, ref], self.histories[project, repository, ref]

    def sources(self, spark) -> Sources:
        repos = sorted({k[:2] for k in self.trees})
        tips = [(*k, sha(repr((sorted(t.items()), sorted(self.histories[k]))))) for k, t in self.trees.items()]
        contents = {b for t in self.trees.values() for b in t.values()}
        subjects = {(k[0], k[1], s) for k, h in self.histories.items() for s in h}
        frame = spark.createDataFrame
        return Sources(
            frame([(p, r, p.upper(), r.upper(), MASTER, self.regex.get((p, r), DEFAULT_REF_REGEX)) for p, r in repos],
                  schemas.REPOSITORIES),
            frame(tips, schemas.BRANCHES),
            frame([(*k, path, self.blob(b)) for k, t in self.trees.items() for path, b in t.items()], schemas.TREE),
            frame([(self.blob(b), len(b), b) for b in contents], schemas.BLOBS),
            frame([(*k, sha(s)) for k, h in self.histories.items() for s in h], schemas.REACH),
            frame([(p, r, "\u0002".join([sha(s), "1704067200", "Ann Lee", "al@x.org", s])) for p, r, s in subjects],
                  schemas.COMMIT_LOG),
        )

    @staticmethod
    def blob(content: bytes) -> str:
        return hashlib.sha1(content).hexdigest()

    def files(self, max_size: int = 262_144, selected=(MASTER, DEVELOP)) -> dict[str, tuple[str, ...]]:
        """doc_id -> refs that the index should hold."""
        out: dict[str, set[str]] = {}
        for (p, r, ref), tree in self.trees.items():
            if ref not in selected:
                continue
            for path, b in tree.items():
                binary = any(c <= 8 or 14 <= c <= 31 or c == 127 for c in b)
                if len(b) <= max_size and not binary:
                    out.setdefault(f"{p}^{r}^{self.blob(b)}^:/{path}", set()).add(ref)
        return {k: tuple(sorted(v)) for k, v in out.items()}

    def commits(self, selected=(MASTER, DEVELOP)) -> dict[str, tuple[str, ...]]:
        out: dict[str, set[str]] = {}
        for (p, r, ref), history in self.histories.items():
            if ref in selected:
                for s in history:
                    out.setdefault(f"{p}^{r}^{sha(s)}", set()).add(ref)
        return {k: tuple(sorted(v)) for k, v in out.items()}


def random_world(rng: random.Random) -> World:
    world = World()
    for repository in ("one", "two", "three"):
        for ref in (MASTER, DEVELOP, TOPIC):
            paths = rng.sample([f"src/f{i}.py" for i in range(12)], rng.randint(1, 9))
            tree = {p: rng.choice([b"alpha\nbeta\n", b"gamma", b"", b"bin\x00ary", b"delta \xe9 x"]) for p in paths}
            world.set("proj", repository, ref, tree, set(rng.sample([f"c{i}" for i in range(9)], 4)))
    return world


def refs_by_id(df) -> dict[str, tuple[str, ...]]:
    rows = df.select("doc_id", "refs").collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: tuple(r["refs"]) for r in rows}
