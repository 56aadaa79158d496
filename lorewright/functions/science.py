"""Scientific helpers: code validation, formulas and their domains, quantum states and operators."""

from __future__ import annotations

import ast
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lorewright.functions.text import strip

# -- code validation (the code is parsed, never run)

# Modules, attributes and builtins that generated code must not use.
BLOCKED_IMPORTS = frozenset([
    "os", "sys", "subprocess", "socket", "requests", "urllib", "http", "ftplib", "smtplib", "pickle", "shelve", "__import__", "importlib", "eval", "exec",
    "compile", "open", "shutil", "pathlib", "glob",
])
DANGEROUS_ATTRIBUTES = frozenset([
    "__class__", "__bases__", "__subclasses__", "__mro__", "__globals__", "__code__", "__builtins__", "__import__", "__getattribute__", "__setattr__",
    "__delattr__", "func_globals", "gi_frame", "f_locals", "f_globals",
])
DANGEROUS_BUILTINS = frozenset([
    "eval", "exec", "compile", "__import__", "open", "getattr", "setattr", "delattr", "globals", "locals", "vars", "dir", "type", "object",
])


def code_issues(code: str) -> list[tuple[str, str, int]]:
    """(severity, what, line) of a piece of Python."""
    try:
        root = ast.parse(code)
    except SyntaxError as e:
        return [("error", "syntax", e.lineno or 0)]
    out = []
    for node in ast.walk(root):
        if isinstance(node, ast.Import | ast.ImportFrom):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""]
            out += [("error", f"import {n}", node.lineno) for n in names if n.split(".")[0] in BLOCKED_IMPORTS]
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in DANGEROUS_BUILTINS:
            out.append(("error", f"call {node.func.id}", node.lineno))
        elif isinstance(node, ast.Attribute) and node.attr in DANGEROUS_ATTRIBUTES:
            out.append(("error", f"attribute {node.attr}", node.lineno))
        elif isinstance(node, ast.While) and isinstance(node.test, ast.Constant) and node.test.value and not any(isinstance(x, ast.Break | ast.Return) for x in ast.walk(node)):
            out.append(("warning", "endless loop", node.lineno))
        elif isinstance(node, ast.FunctionDef) and any(isinstance(x, ast.Call) and isinstance(x.func, ast.Name) and x.func.id == node.name for x in ast.walk(node)):
            out.append(("warning", f"recursion {node.name}", node.lineno))
    return sorted(out, key=lambda i: i[2])


def validate_code(code: Column) -> Column:
    """{valid, issues}; a null is no code."""

    def check(x: pd.Series) -> pd.DataFrame:
        found = [code_issues(c) if c is not None else [("error", "no code", 0)] for c in x]
        return pd.DataFrame({"valid": [all(i[0] != "error" for i in f) for f in found], "issues": [[dict(zip(("severity", "what", "line"), i, strict=True)) for i in f] for f in found]})

    return F.pandas_udf(check, "struct<valid:boolean,issues:array<struct<severity:string,what:string,line:int>>>")(code)


# -- formulas

# Words of each domain, in order of priority.
DOMAINS = {
    "quantum": ["qubit", "quantum", "hilbert", "bra", "ket", "unitary", "hermitian"],
    "linear_algebra": ["matrix", "eigenvalue", "vector", "determinant", "trace"],
    "calculus": ["integral", "derivative", "limit", "series", "convergence"],
    "trigonometry": ["sin", "cos", "tan", "trigonometric", "angle"],
    "algebra": ["group", "ring", "field", "polynomial", "factor"],
}


def domain(content: Column) -> Column:
    low = F.lower(content)
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    return reduce(lambda out, k: F.when(has(DOMAINS[k]), F.lit(k)).otherwise(out), reversed(DOMAINS), F.lit("general"))


def formula_fingerprint(formula: Column) -> Column:
    """A key under which formulas that differ in variable names meet: variables become v, numbers n, blanks go; a proposal for comparison, not a proof."""
    plain = F.regexp_replace(formula, r"\s+", "")
    plain = F.regexp_replace(plain, r"(?<![A-Za-z\\])[A-Za-z](?![A-Za-z])", "v")
    return F.substring(F.sha2(F.regexp_replace(plain, r"\d+(\.\d+)?", "n").cast("binary"), 256), 1, 12)


def compute_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?s)<COMPUTE>(.*?)</COMPUTE>"), F.lit(1))


def without_compute(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?s)<COMPUTE>.*?</COMPUTE>", ""), r"(?s)<RESULT>.*?</RESULT>", ""))


def unsafe_expression(text: Column) -> Column:
    return text.rlike(r"__|\bimport\b|\bexec\b|\beval\b|\bopen\b|\blambda\b|\bos\.|\bsys\.")


# -- quantum operators: complex matrices as NumPy arrays; `matrix` and `cells` go to and from ARRAY<ARRAY<STRUCT<re, im>>>

MATRIX = "array<array<struct<re:double,im:double>>>"
_S = 1 / np.sqrt(2)
GATES = {
    "I": np.eye(2),
    "X": np.array([[0, 1], [1, 0]]),
    "Y": np.array([[0, -1j], [1j, 0]]),
    "Z": np.array([[1, 0], [0, -1]]),
    "H": np.array([[_S, _S], [_S, -_S]]),
    "S": np.array([[1, 0], [0, 1j]]),
    "T": np.array([[1, 0], [0, np.exp(0.25j * np.pi)]]),
    "CNOT": np.array([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0, 1], [0, 0, 1, 0]]),
    "CZ": np.diag([1, 1, 1, -1]),
    "SWAP": np.array([[1, 0, 0, 0], [0, 0, 1, 0], [0, 1, 0, 0], [0, 0, 0, 1]]),
}


def matrix(rows) -> np.ndarray:
    return np.array([[complex(c["re"], c["im"]) for c in r] for r in rows])


def cells(a: np.ndarray) -> list:
    return [[{"re": float(x.real), "im": float(x.imag)} for x in r] for r in np.atleast_2d(a)]


def is_unitary(a: np.ndarray, eps: float = 1e-10) -> bool:
    return a.shape[0] == a.shape[1] and bool(np.allclose(a @ a.conj().T, np.eye(len(a)), atol=eps))


def is_hermitian(a: np.ndarray, eps: float = 1e-10) -> bool:
    return a.shape[0] == a.shape[1] and bool(np.allclose(a, a.conj().T, atol=eps))


def tensor(*parts: np.ndarray) -> np.ndarray:
    return reduce(np.kron, parts)


def partial_trace(rho: np.ndarray, dims: list[int], keep: list[int]) -> np.ndarray:
    n = len(dims)
    t = rho.reshape(*dims, *dims)
    for k in sorted(set(range(n)) - set(keep), reverse=True):
        t = np.trace(t, axis1=k, axis2=k + t.ndim // 2)
    size = int(np.prod([dims[k] for k in keep]))
    return t.reshape(size, size)


def commutator(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b - b @ a


def anticommutator(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b + b @ a


def apply_gate(gate: np.ndarray, state: np.ndarray) -> np.ndarray:
    return gate @ state


def probabilities(state: np.ndarray) -> np.ndarray:
    p = np.abs(np.ravel(state)) ** 2
    return p / p.sum()


def entropy(rho: np.ndarray) -> float:
    """Von Neumann entropy in bits."""
    w = np.linalg.eigvalsh(rho)
    w = w[w > 1e-12]
    return float(max(0.0, -(w * np.log2(w)).sum()))


def fidelity(a: np.ndarray, b: np.ndarray) -> float:
    """Squared overlap of two states, or the general form for density matrices."""
    if a.ndim == 1:
        return float(abs(np.vdot(a, b)) ** 2)
    w, v = np.linalg.eigh(a)
    root = (v * np.sqrt(np.maximum(w, 0))) @ v.conj().T
    return float(np.sqrt(np.maximum(np.linalg.eigvalsh(root @ b @ root), 0)).sum() ** 2)


def is_state(rho: np.ndarray, eps: float = 1e-10) -> bool:
    """Hermitian, trace 1 and no negative eigenvalue."""
    return is_hermitian(rho, eps) and abs(np.trace(rho) - 1) < eps and bool(np.linalg.eigvalsh(rho).min() > -eps)


def matrix_kinds(rows: Column) -> Column:
    """{unitary, hermitian, density} of a matrix column."""

    def kinds(x: pd.Series) -> pd.DataFrame:
        m = [matrix(r) for r in x]
        return pd.DataFrame({"unitary": [is_unitary(a) for a in m], "hermitian": [is_hermitian(a) for a in m], "density": [a.shape[0] == a.shape[1] and is_state(a) for a in m]})

    return F.pandas_udf(kinds, "struct<unitary:boolean,hermitian:boolean,density:boolean>")(rows)
