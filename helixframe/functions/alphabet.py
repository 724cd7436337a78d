"""Base alphabets and genetic codes as plain tables."""

from __future__ import annotations

import string

#: Complements of the IUPAC letters; every other letter complements to N.
COMPLEMENTS = {"A": "T", "B": "V", "C": "G", "D": "H", "G": "C", "H": "D", "K": "M", "M": "K", "N": "N", "R": "Y", "S": "S", "T": "A", "U": "A", "V": "B", "W": "W", "Y": "R", "Z": "T"}
LETTERS = string.ascii_uppercase + string.ascii_lowercase
COMPLEMENT_LETTERS = "".join(COMPLEMENTS.get(c, "N") for c in string.ascii_uppercase)
COMPLEMENT_LETTERS += COMPLEMENT_LETTERS.lower()

#: Bases in the order of their two-bit addresses; U counts as T.
ORDER = "TCAG"
CODONS = [a + b + c for a in ORDER for b in ORDER for c in ORDER]

#: Fixed value: NCBI translation table 11 over the codons in the order above.
TABLE_11 = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: The amino acid that a stop codon of table 11 has in another code.
READ_THROUGH = {"1": {}, "4": {"TGA": "W"}, "11": {}, "15": {"TAG": "Q"}, "16": {"TAG": "L"}, "25": {"TGA": "G"}}
STARTS = ["ATG", "GTG", "TTG"]
STOPS = ["TAA", "TAG", "TGA"]


def genetic_code(table: str = "11") -> dict[str, str]:
    """codon -> amino acid, * for a stop."""
    if table not in READ_THROUGH:
        raise ValueError(f"genetic code {table} is not one of {', '.join(READ_THROUGH)}")
    return dict(zip(CODONS, TABLE_11, strict=True)) | READ_THROUGH[table]


def start_codons(table: str = "11") -> list[str]:
    return STARTS[:1] if table == "1" else STARTS


def stop_codons(table: str = "11") -> list[str]:
    code = genetic_code(table)
    return [c for c in STOPS if code[c] == "*"]
