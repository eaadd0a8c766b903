"""Vocabulary and constants of the address grammar.

Fixed values: they decide which texts are the same address.
"""

from __future__ import annotations

#: Accepted spelling of a road type -> its code.
VIA_TYPES = {
    "CL": "CL",
    "CALLE": "CL",
    "CLL": "CL",
    "CLLE": "CL",
    "C": "CL",
    "KR": "KR",
    "CARRERA": "KR",
    "CRA": "KR",
    "KRA": "KR",
    "CARR": "KR",
    "CRRA": "KR",
    "CR": "KR",
    "K": "KR",
    "AV": "AV",
    "AVENIDA": "AV",
    "AVDA": "AV",
    "AVEN": "AV",
    "AVE": "AV",
    "A": "AV",
    "AC": "AC",
    "AK": "AK",
    "DG": "DG",
    "DIAGONAL": "DG",
    "DIAG": "DG",
    "DIAGO": "DG",
    "D": "DG",
    "TV": "TV",
    "TRANSVERSAL": "TV",
    "TRANSV": "TV",
    "TRV": "TV",
    "T": "TV",
    "PJ": "PJ",
    "PASAJE": "PJ",
    "PS": "PS",
    "PASEO": "PS",
    "CV": "CV",
    "CIRCUNVALAR": "CV",
    "AU": "AU",
    "AUTOPISTA": "AU",
    "CT": "CT",
    "CALLEJON": "CT",
}
TWO_WORD_VIA_TYPES = {"AVENIDA CALLE": "AC", "AVENIDA CARRERA": "AK"}

QUADRANTS = ("NORTE", "SUR", "ESTE", "OESTE")
QUADRANT_LETTERS = {"N": "NORTE", "S": "SUR", "E": "ESTE", "O": "OESTE", "W": "OESTE"}

#: Accepted spelling of a kind of complement -> its code.
KINDS = {
    "AP": "AP",
    "APTO": "AP",
    "APT": "AP",
    "APART": "AP",
    "APARTAMENTO": "AP",
    "TO": "TO",
    "TORRE": "TO",
    "LC": "LC",
    "LOCAL": "LC",
    "LOC": "LC",
    "CA": "CA",
    "CASA": "CA",
    "ET": "ET",
    "ETAPA": "ET",
    "PISO": "PISO",
    "BLQ": "BLQ",
    "BLOQUE": "BLQ",
    "BLOQ": "BLQ",
    "BL": "BLQ",
    "MZ": "MZ",
    "MANZANA": "MZ",
    "LT": "LT",
    "LOTE": "LT",
    "PH": "PH",
    "OF": "OF",
    "OFICINA": "OF",
    "OFIC": "OF",
    "ED": "ED",
    "EDIFICIO": "ED",
    "EDIF": "ED",
    "EDF": "ED",
    "CONJ": "CONJ",
    "CONJUNTO": "CONJ",
    "UR": "UR",
    "URBANIZACION": "UR",
    "INT": "INT",
    "INTERIOR": "INT",
    "PQ": "PQ",
    "PARQUEADERO": "PQ",
    "GA": "GA",
    "GARAJE": "GA",
    "BG": "BG",
    "BODEGA": "BG",
    "BR": "BR",
    "BARRIO": "BR",
    "CGTO": "CGTO",
    "CORREGIMIENTO": "CGTO",
    "VDA": "VDA",
    "VEREDA": "VDA",
}
OPAQUE_KIND = "?"

MAX_TAIL = 40
MAX_PLATE_DIGITS = 6
THRESHOLD = 0.90
TOLERANCE = 0

PENALTIES = {
    "one_sided": 0.15,
    "conflict": 0.30,
    "cross_type_one_sided": 0.03,
    "cross_type_conflict": 0.30,
    "plate_tolerance": 0.04,
    "complement_one_sided": 0.02,
}

SEGMENT = ("type", "number", "letters", "suffix", "suffix_letters", "bis", "quadrant")
FIELDS = tuple(f"{side}_{f}" for side in ("via", "cross") for f in SEGMENT) + ("plate", "complement")
HARD_FIELDS = ("via_type", "via_number", "cross_number")
SOFT_FIELDS = tuple(f"{side}_{f}" for side in ("via", "cross") for f in ("letters", "suffix", "suffix_letters", "quadrant"))
BIS_FIELDS = ("via_bis", "cross_bis")
LABELS = {
    "via_type": "tipo de vía",
    "via_number": "número de vía",
    "cross_number": "número de vía generadora",
    "plate": "placa",
    "complement": "complemento",
}


#: Code of a road type -> the word that a positive variant writes.
VIA_LONG = {
    "KR": "CARRERA",
    "CL": "CALLE",
    "AV": "AVENIDA",
    "AC": "AVENIDA CALLE",
    "AK": "AVENIDA CARRERA",
    "DG": "DIAGONAL",
    "TV": "TRANSVERSAL",
    "PJ": "PASAJE",
    "PS": "PASEO",
    "CV": "CIRCUNVALAR",
    "AU": "AUTOPISTA",
    "CT": "CALLEJON",
}
#: Code of a road type -> its short form with a dot.
VIA_DOTTED = {
    "KR": "CRA.",
    "CL": "CLL.",
    "AV": "AV.",
    "AC": "AC.",
    "AK": "AK.",
    "DG": "DG.",
    "TV": "TV.",
    "PJ": "PJ.",
    "PS": "PS.",
    "CV": "CV.",
    "AU": "AU.",
    "CT": "CT.",
}
#: Code of a kind -> the word that a positive variant writes.
KIND_LONG = {
    "AP": "APTO",
    "TO": "TORRE",
    "LC": "LOCAL",
    "CA": "CASA",
    "ET": "ETAPA",
    "BLQ": "BLOQUE",
    "MZ": "MANZANA",
    "LT": "LOTE",
    "OF": "OFICINA",
    "ED": "EDIFICIO",
    "CONJ": "CONJUNTO",
    "INT": "INTERIOR",
    "PQ": "PARQUEADERO",
    "GA": "GARAJE",
    "BG": "BODEGA",
    "BR": "BARRIO",
    "UR": "URBANIZACION",
    "VDA": "VEREDA",
    "CGTO": "CORREGIMIENTO",
}
#: Road type as written -> the word for it in synthetic positives.
SYNTHETIC_TYPE_LONG = {
    "KR": "CARRERA",
    "K": "CARRERA",
    "CARRERA": "CARRERA",
    "CL": "CALLE",
    "C": "CALLE",
    "CALLE": "CALLE",
    "AV": "AVENIDA",
    "A": "AVENIDA",
    "AVENIDA": "AVENIDA",
    "DG": "DIAGONAL",
    "D": "DIAGONAL",
    "DIAGONAL": "DIAGONAL",
    "TV": "TRANSVERSAL",
    "T": "TRANSVERSAL",
    "TRANSVERSAL": "TRANSVERSAL",
    "CIRCULAR": "CIRCULAR",
}
#: Word for a road type -> its short forms in synthetic positives.
SYNTHETIC_TYPE_SHORT = {
    "CARRERA": ["KR", "CRA", "KRA", "K", "CR"],
    "CALLE": ["CL", "CLL", "C"],
    "AVENIDA": ["AV"],
    "DIAGONAL": ["DG", "D"],
    "TRANSVERSAL": ["TV", "T"],
}
#: Word for a road type -> short forms that are rarely written.
SYNTHETIC_TYPE_NOVEL = {
    "CARRERA": ["CARR", "CRRA"],
    "AVENIDA": ["AVDA", "AVEN", "AVE"],
    "DIAGONAL": ["DIAG", "DIAGO"],
    "TRANSVERSAL": ["TRANSV", "TRV"],
    "CIRCULAR": ["CIR", "CIRC"],
}
#: Code of a kind -> its words in synthetic positives.
SYNTHETIC_KIND_LONG = {
    "AP": ["APARTAMENTO", "APTO"],
    "BLQ": ["BLOQUE", "BL"],
    "ED": ["EDIFICIO"],
    "CA": ["CASA"],
    "LC": ["LOCAL"],
    "OF": ["OFICINA"],
    "INT": ["INTERIOR"],
    "TO": ["TORRE"],
    "PQ": ["PARQUEADERO"],
}
#: Code of a kind -> forms that are rarely written.
SYNTHETIC_KIND_NOVEL = {
    "AP": ["APT", "APT.", "APART"],
    "LC": ["LOC", "LOC."],
    "OF": ["OFIC"],
    "ED": ["EDIF", "EDF"],
    "BLQ": ["BLOQ"],
}


def alternation(words) -> str:
    """A regular expression for any of the words, longer ones first."""
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))
