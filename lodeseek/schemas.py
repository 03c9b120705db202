"""Schemas of the document tables and of the tables they are built from."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_S, _I, _REFS = T.StringType(), T.IntegerType(), T.ArrayType(T.StringType())

FILES = _struct(
    doc_id=_S, project=_S, repository=_S, refs=_REFS, blob=_S, path=_S,
    extension=_S, contents=_S, charcount=_I, linecount=_I,
)
COMMITS = _struct(
    doc_id=_S, project=_S, repository=_S, refs=_REFS, hash=_S, commitdate=T.TimestampType(),
    authorname=_S, authoremail=_S, subject=_S, body=_S,
)
CHECKPOINTS = _struct(project=_S, repository=_S, ref=_S, hash=_S)

REPOSITORIES = _struct(
    project=_S, repository=_S, projectname=_S, repositoryname=_S,
    default_branch=_S, ref_regex=_S,
)
BRANCHES = _struct(project=_S, repository=_S, ref=_S, tip=_S)
GRANTS = _struct(user_id=_S, project=_S, repository=_S)
TREE = _struct(project=_S, repository=_S, ref=_S, path=_S, blob=_S)
BLOBS = _struct(blob=_S, size=_I, content=T.BinaryType())
REACH = _struct(project=_S, repository=_S, ref=_S, hash=_S)
COMMIT_LOG = _struct(project=_S, repository=_S, record=_S)
REF_EVENTS = _struct(
    event_id=T.LongType(), ts=T.TimestampType(), project=_S, repository=_S, ref=_S,
    change_type=_S,
)

# ``tree`` and ``reach`` are the snapshots that were indexed, files and commits without a document included.
TABLES = {"files": FILES, "commits": COMMITS, "checkpoints": CHECKPOINTS, "tree": TREE, "reach": REACH}
# Tables that grow with every version and are never rewritten; a full build begins them anew.
_B, _L = T.BooleanType(), T.LongType()
APPENDED = {
    "occurrences": _struct(field=_S, term=_S, doc=T.BinaryType(), positions=T.ArrayType(_I), length=_I),
    "words": _struct(field=_S, term=_S, df=_L),
    "rotations": _struct(field=_S, rotated=_S, long=_B),
    "deletions": _struct(field=_S, left=_S, term=_S),
}
# What tells rows of one repository apart.
UNITS = {"files": "doc_id", "commits": "doc_id", "checkpoints": "ref", "tree": "path", "reach": "hash"}
REPO_KEY = ("project", "repository")
