"""Text functions as Spark columns: tokens, token estimates, hashes, accents, whitespace, maths vocabulary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spanish and English stopwords of the lexical index.
STOPWORDS_ES = [
    "de", "la", "el", "en", "y", "a", "los", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo", "como", "más", "pero", "sus",
    "le", "ya", "o", "este", "sí", "porque", "esta", "entre", "cuando", "muy", "sin", "sobre", "también", "me", "hasta", "hay", "donde", "quien", "desde",
    "todo", "nos", "durante", "todos", "uno", "les", "ni", "contra", "otros", "ese", "eso", "ante", "ellos", "e", "esto", "mí", "antes", "algunos", "qué",
    "unos", "yo", "otro", "otras", "otra", "él", "tanto", "esa", "estos", "mucho", "quienes", "nada", "muchos", "cual", "poco", "ella", "estar", "estas",
    "algunas", "algo", "nosotros", "mi", "mis", "tú", "te", "ti", "tu", "tus", "se", "que", "fue", "son", "ser", "ha", "sido", "tiene",
]
STOPWORDS_EN = [
    "the", "be", "to", "of", "and", "a", "in", "that", "have", "i", "it", "for", "not", "on", "with", "he", "as", "you", "do", "at", "this", "but", "his",
    "by", "from", "they", "we", "say", "her", "she", "or", "an", "will", "my", "one", "all", "would", "there", "their", "what", "so", "up", "out", "if",
    "about", "who", "get", "which", "go", "me", "when", "make", "can", "like", "time", "no", "just", "him", "know", "take", "people", "into", "year",
    "your", "some", "could", "them", "see", "other", "than", "then", "now", "look", "only", "come", "its", "over", "think", "also", "back", "after",
    "use", "two", "how", "our", "way", "even", "new", "is", "are", "was", "were", "been", "being", "has", "had",
]
STOPWORDS = sorted({*STOPWORDS_ES, *STOPWORDS_EN})
# Characters that are deleted (not replaced by a blank) before splitting.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¿¡«»—–·"

# Accented letters and their plain forms, for comparisons without accents.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"


def tokens(text: Column) -> Column:
    """Lower-cased words without punctuation, of two characters or more, that are no stopwords; repetitions stay."""
    words = F.split(F.translate(F.lower(text), PUNCTUATION, ""), r"\s+")
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS))  # a hash set after optimisation


def token_estimate(text: Column) -> Column:
    """One token for three characters, rounded down."""
    return F.floor(F.length(text) / 3).cast("int")


def strip_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def short_hash(text: Column, n: int = 16) -> Column:
    """First n hexadecimal digits of the SHA-256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, n)


def point_id(key: Column) -> Column:
    """Unsigned 64-bit number of the first 16 digits of the SHA-256."""
    return F.conv(short_hash(key, 16), 16, 10).cast("decimal(20,0)")


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\f"))


def clean_whitespace(text: Column) -> Column:
    """Blanks and tabs collapse, three or more line breaks become two, lines are trimmed."""
    out = F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.array_join(F.transform(F.split(out, "\n"), strip), "\n")


def excerpt(text: Column, n: int = 150) -> Column:
    """At most n characters, cut at the last blank, with an ellipsis."""
    return F.when(F.length(text) > n, F.concat(F.regexp_replace(F.substring(text, 1, n), " [^ ]*$", ""), F.lit("..."))).otherwise(text)


def truncate_tokens(text: Column, n: int = 8191) -> Column:
    return F.substring(text, 1, 3 * n)


# LaTeX commands and the terms they stand for.
LATEX_TERMS = {
    r"\sum": ["sumatorio", "summation", "sum", "suma"],
    r"\prod": ["productorio", "product", "producto"],
    r"\int": ["integral", "integration", "integración"],
    r"\oint": ["integral de contorno", "contour integral", "line integral"],
    r"\lim": ["límite", "limit"],
    r"\partial": ["derivada parcial", "partial derivative"],
    r"\nabla": ["gradiente", "gradient", "nabla", "del operator"],
    r"\Delta": ["laplaciano", "laplacian", "delta"],
    r"\det": ["determinante", "determinant"],
    r"\Tr": ["traza", "trace"],
    r"\rank": ["rango", "rank"],
    r"\dim": ["dimensión", "dimension"],
    r"\ker": ["núcleo", "kernel"],
    r"\im": ["imagen", "image"],
    r"\span": ["espacio generado", "span"],
    r"\otimes": ["producto tensorial", "tensor product", "kronecker"],
    r"\oplus": ["suma directa", "direct sum"],
    r"\times": ["producto cruz", "cross product"],
    r"\cdot": ["producto escalar", "dot product", "scalar product"],
    r"\wedge": ["producto exterior", "wedge product", "exterior product"],
    r"\bra": ["bra", "dual vector", "vector dual"],
    r"\ket": ["ket", "estado cuántico", "quantum state", "state vector"],
    r"\braket": ["producto interno", "inner product", "bracket"],
    r"\rho": ["matriz de densidad", "density matrix", "operador densidad"],
    r"\psi": ["función de onda", "wave function", "estado", "state"],
    r"\phi": ["fase", "phase", "estado", "state"],
    r"\hbar": ["constante de Planck reducida", "reduced Planck constant"],
    r"\hat": ["operador", "operator"],
    r"\mathcal{H}": ["espacio de Hilbert", "Hilbert space"],
    r"\mathbb{R}": ["números reales", "real numbers", "reals"],
    r"\mathbb{C}": ["números complejos", "complex numbers"],
    r"\mathbb{Z}": ["enteros", "integers"],
    r"\mathbb{N}": ["naturales", "natural numbers"],
    r"\sin": ["seno", "sine"],
    r"\cos": ["coseno", "cosine"],
    r"\tan": ["tangente", "tangent"],
    r"\exp": ["exponencial", "exponential"],
    r"\log": ["logaritmo", "logarithm"],
    r"\ln": ["logaritmo natural", "natural logarithm"],
    r"\sqrt": ["raíz cuadrada", "square root"],
    r"\equiv": ["equivalente", "equivalent", "congruente"],
    r"\approx": ["aproximadamente", "approximately"],
    r"\propto": ["proporcional", "proportional"],
    r"\sim": ["similar", "distribuido como", "distributed as"],
    r"\subset": ["subconjunto", "subset"],
    r"\subseteq": ["subconjunto", "subset"],
    r"\in": ["pertenece", "belongs to", "element of"],
    r"\forall": ["para todo", "for all"],
    r"\exists": ["existe", "exists"],
    r"\begin{matrix}": ["matriz", "matrix"],
    r"\begin{pmatrix}": ["matriz", "matrix", "parenthesis matrix"],
    r"\begin{bmatrix}": ["matriz", "matrix", "bracket matrix"],
    r"\begin{vmatrix}": ["determinante", "determinant"],
    r"\text{CNOT}": ["CNOT", "controlled NOT", "puerta controlada"],
    r"\text{H}": ["Hadamard", "puerta Hadamard"],
    r"\text{X}": ["Pauli X", "NOT gate", "bit flip"],
    r"\text{Y}": ["Pauli Y"],
    r"\text{Z}": ["Pauli Z", "phase flip"],
    r"\text{T}": ["T gate", "puerta T", "pi/8 gate"],
    r"\text{S}": ["S gate", "puerta S", "phase gate"],
    r"\text{SWAP}": ["SWAP", "intercambio"],
    r"\text{Toffoli}": ["Toffoli", "CCNOT", "puerta Toffoli"],
}
# Patterns (any case) of concepts and algorithms, with their terms.
CONCEPTS = {
    "eigenvalue|autovalor|valor propio": ["eigenvalue", "autovalor", "valor propio"],
    "eigenvector|autovector|vector propio": ["eigenvector", "autovector", "vector propio"],
    "hermitian|hermítico|hermitiano": ["hermitiano", "hermitian", "self-adjoint"],
    "unitary|unitario|unitaria": ["unitario", "unitary"],
    "orthogonal|ortogonal": ["ortogonal", "orthogonal"],
    "normalized?|normalizado": ["normalizado", "normalized"],
    "entangle|entrelaz": ["entrelazamiento", "entanglement", "entangled"],
    "superposition|superposición": ["superposición", "superposition"],
    "decoherence|decoherencia": ["decoherencia", "decoherence"],
    "measurement|medición|medida": ["medición", "measurement"],
    "observable": ["observable"],
    "hamiltonian|hamiltoniano": ["hamiltoniano", "hamiltonian"],
    "lagrangian|lagrangiano": ["lagrangiano", "lagrangian"],
    "commutator|conmutador": ["conmutador", "commutator"],
    "probability|probabilidad": ["probabilidad", "probability"],
    "amplitude|amplitud": ["amplitud", "amplitude"],
    "phase|fase": ["fase", "phase"],
    "fidelity|fidelidad": ["fidelidad", "fidelity"],
    "coherence|coherencia": ["coherencia", "coherence"],
    "teleportation|teleportación|teletransporte": ["teleportación", "teleportation"],
    "fourier": ["Fourier", "transformada de Fourier", "Fourier transform"],
    "algorithm|algoritmo": ["algoritmo", "algorithm"],
    "circuit|circuito": ["circuito", "circuit"],
    "qubit": ["qubit", "bit cuántico", "quantum bit"],
    "qutrit": ["qutrit"],
    "register|registro": ["registro", "register"],
    "oracle|oráculo": ["oráculo", "oracle"],
    "ancilla": ["ancilla", "qubit auxiliar"],
    "shor|factoriza": ["algoritmo de Shor", "Shor's algorithm", "factorización"],
    "grover|búsqueda": ["algoritmo de Grover", "Grover's algorithm", "búsqueda cuántica"],
    "deutsch|jozsa": ["Deutsch-Jozsa", "algoritmo de Deutsch"],
    "simon": ["algoritmo de Simon", "Simon's algorithm"],
    "bernstein|vazirani": ["Bernstein-Vazirani"],
    "qft|quantum fourier": ["QFT", "transformada de Fourier cuántica", "quantum Fourier transform"],
    "vqe|variational": ["VQE", "variational quantum eigensolver"],
    "qaoa": ["QAOA", "quantum approximate optimization"],
    "qpe|phase estimation": ["QPE", "estimación de fase", "phase estimation"],
}
DIRAC = ["notación de Dirac", "Dirac notation", "bra-ket"]
DIRAC_PATTERN = r"\|[^|>]+\s*[>⟩]|[<⟨]\s*[^|<]+\|"
# Greek letters that count as symbols.
GREEK = [
    "alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "pi", "rho", "sigma", "tau",
    "upsilon", "phi", "chi", "psi", "omega", "Gamma", "Delta", "Theta", "Lambda", "Xi", "Pi", "Sigma", "Upsilon", "Phi", "Psi", "Omega",
]
MAX_TERMS = 50


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def math_concepts(text: Column) -> Column:
    """Sorted distinct concepts by context, algorithms and bra-ket notation included."""
    empty = F.array().cast("array<string>")
    found = [F.when(text.rlike(f"(?iu){p}"), _words(t)).otherwise(empty) for p, t in CONCEPTS.items()]
    found.append(F.when(text.rlike(DIRAC_PATTERN) | F.contains(text, F.lit(r"\ket")) | F.contains(text, F.lit(r"\bra")), _words(DIRAC)).otherwise(empty))
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found))))


def math_terms(text: Column) -> Column:
    """Sorted distinct terms of LaTeX commands (found as substrings) and concepts, the first 50."""
    empty = F.array().cast("array<string>")
    latex = F.flatten(F.array(*[F.when(F.contains(text, F.lit(c)), _words(t)).otherwise(empty) for c, t in LATEX_TERMS.items()]))
    return F.slice(F.array_sort(F.array_distinct(F.concat(latex, math_concepts(text)))), 1, MAX_TERMS)


def math_symbols(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\\(" + "|".join(GREEK) + ")"), F.lit(1))))


def formulas(text: Column) -> Column:
    """Inline formulas, then displayed ones, the first 20."""
    inline = F.regexp_extract_all(text, F.lit(r"\$([^$]+)\$"), F.lit(1))
    return F.slice(F.concat(inline, F.regexp_extract_all(text, F.lit(r"\$\$([^$]+)\$\$"), F.lit(1))), 1, 20)


def searchable_text(text: Column) -> Column:
    """The text with up to 30 of its terms as a suffix."""
    terms = math_terms(text)
    return F.when(F.size(terms) == 0, text).otherwise(F.concat(text, F.lit(" | Términos: "), F.array_join(F.slice(terms, 1, 30), ", ")))


# Expansions of a query's words, in order.
EXPANSIONS = {
    "sumatorio": "sumatorio summation sum sigma",
    "integral": "integral integration",
    "derivada": "derivada derivative partial",
    "matriz": "matriz matrix matrices",
    "determinante": "determinante determinant",
    "autovalor": "autovalor eigenvalue valor propio",
    "autovector": "autovector eigenvector vector propio",
    "entrelazamiento": "entrelazamiento entanglement entangled",
    "superposición": "superposición superposition",
    "qubit": "qubit quantum bit",
    "circuito": "circuito circuit quantum circuit",
    "puerta": "puerta gate quantum gate",
    "Hadamard": "Hadamard H gate",
    "CNOT": "CNOT controlled NOT CX",
}


def normalize_math_query(query: Column) -> Column:
    """Expands words that the original query has, whatever earlier expansions brought."""
    # where the original lacks the word, a match that an expansion brought is put back as it is
    to = lambda p, word: F.when(query.rlike(p), F.lit(EXPANSIONS[word])).otherwise(F.lit("$0"))
    step = lambda out, word: F.regexp_replace(out, F.lit(p := rf"(?iU)\b{word}\b"), to(p, word))
    return reduce(step, EXPANSIONS, query)


def formula_description(formula: Column) -> Column:
    has = lambda *parts: reduce(lambda a, b: a & b, [F.contains(formula, F.lit(p)) for p in parts])
    said = lambda when, text: F.when(when, F.lit(text))
    found = F.concat_ws(
        ", ",
        F.when(has(r"\sum"), F.when(has("_{", "}^{"), F.lit("sumatorio con límites")).otherwise(F.lit("sumatorio"))),
        F.when(has(r"\int"), F.when(has("_0") | has("_{0}"), F.lit("integral definida")).otherwise(F.lit("integral"))),
        said(has(r"\frac"), "fracción"),
        said(has(r"\sqrt"), "raíz cuadrada"),
        said(has(r"\lim"), "límite"),
        said(has("|", r"\rangle") | has(r"\ket"), "estado cuántico ket"),
        said(has(r"\langle") | has(r"\bra"), "bra estado dual"),
        said(has(r"\otimes"), "producto tensorial"),
        said(has(r"\text{H}") | has(r"\hat{H}"), "Hamiltoniano u operador Hadamard"),
        said(has(r"\rho"), "matriz de densidad"),
    )
    return F.when(found == "", F.lit("expresión matemática")).otherwise(found)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def json_items(text: Column, schema: str) -> Column:
    """Lenient reading of a JSON array: the text itself, else what stands from its first '[' to its last ']'."""
    return F.coalesce(F.from_json(text, schema), F.from_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1), schema))
