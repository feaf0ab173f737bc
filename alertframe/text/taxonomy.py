"""The taxonomy of time-domain sources: classes, their paths and their other names.

The tables below are one version of a public taxonomy; load() reads another one from a folder of YAML files. Other names
of supernova types that follow a rule are made by it.
"""

from __future__ import annotations

import re
from functools import cache
from pathlib import Path
from typing import Any

ROOT = "Time-domain Source"
# The classes below each class.
CHILDREN = {
    "Time-domain Source": ["Nonstellar", "Stellar variable"],
    "Nonstellar": ["DM annihilation", "Solar System Object", "Galactic Nuclei", "gravitational lensing"],
    "Galactic Nuclei": ["Tidal Disruption Event", "AGN"],
    "AGN": ["Seyfert", "QSO", "Blazar"],
    "Blazar": ["OVV", "BL Lac"],
    "Stellar variable": ["Cataclysmic", "Eclipsing", "Rotating", "Eruptive", "Pulsating", "microlensing"],
    "Cataclysmic": ["compact merger", "GRB", "Supernova", "Novae"],
    "compact merger": ["DNS", "NS-BH"],
    "DNS": ["kilonova"],
    "NS-BH": ["kilonova"],
    "GRB": ["short GRB", "long GRB", "X-ray Flash", "afterglow"],
    "Supernova": ["Type I", "Type II", "FBOT", "Ca-rich", "ILRT", "Id", "Ie"],
    "Type I": ["Ia", "Ib", "Ic", "Ib/c"],
    "Ia": ["Ia-pec", "Ia-norm", "Ia-91T", "Ia-91bg", "Ia-99aa", "Ia-00cx", "Ia-02cx", "Ia-CSM", "Ia-03fg", "Ia-18byg"],
    "Ib": ["Ib-pec", "Ib-norm", "Ibn"],
    "Ic": ["Ic-BL", "Ic-SLSN", "Ic.5-SLSN", "Ic-pec", "Ic-norm", "Icn"],
    "Type II": ["IIn", "II-norm", "IIb", "IIb-pec", "II-pec", "II-SLSN"],
    "II-norm": ["IIP", "IIL"],
    "Id": ["Idn"],
    "Ie": ["Ien"],
    "Novae": ["Classical Nova", "Luminous Red Nova", "Nova-like", "Polars", "Recurrent Nova", "U Gem"],
    "Nova-like": ["SW Sex", "VY Scl", "UX UMa", "AM CVn"],
    "Polars": ["AM Her", "DQ Her"],
    "U Gem": ["SS Cyg", "Z Cam", "SU UMaj"],
    "SU UMaj": ["ER U Maj", "WZ Sge"],
    "Eclipsing": ["Beta Lyrae", "X-Ray Burster", "System with Planet(s)", "RS CVn", "W Ursae Maj", "Algol", "Symbiotic Var", "Compact Binary"],
    "W Ursae Maj": ["EWa", "EWw"],
    "Algol": ["detached MS-MS", "HW Vir"],
    "Compact Binary": ["DWD", "NN Ser", "Redback Pulsar"],
    "Rotating": ["SX Ari", "Alpha2 CVn", "FK Comae Bern", "Pulsar", "BY Dra"],
    "Alpha2 CVn": ["Rapidly Oscillating"],
    "Eruptive": ["UV Ceti", "S Doradus", "Wolf-Rayet", "Gamma Cas", "R Cor Borealis", "YSO", "FS CMa"],
    "Gamma Cas": ["Be", "Shell"],
    "R Cor Borealis": ["DY Per"],
    "YSO": ["FU Ori", "Orion", "Herbig AE/BE"],
    "Orion": ["w/Abs", "T Tauri"],
    "T Tauri": ["TTc", "TTw"],
    "Pulsating": [
        "Gamma Doradus", "SX Phe", "RR Lyrae", "Alpha Cygni", "LPV", "RV Tau", "Pulsating WD", "Sun analogue", "Delta Scuti", "PV Telescopii",
        "Beta Cephei", "Population II Cepheid", "Cepheid", "SPB", "BLAP",
    ],
    "RR Lyrae": ["RRcl", "RRab", "RRc", "RRd", "RRe", "Blazhko"],
    "LPV": ["Mira", "Semiregular", "OSARG"],
    "Semiregular": ["SRa/Z-Aquarii", "SRb", "SRc", "SRd"],
    "RV Tau": ["Const Mean Mag", "Var Mean Mag"],
    "Pulsating WD": ["GW VIr", "ZZ Ceti"],
    "ZZ Ceti": ["H abs only", "He abs only", "Showing HeII"],
    "Delta Scuti": ["Low-Amp", "High-Amp", "PMS Delta Scuti"],
    "Population II Cepheid": ["BL Her", "W Vir"],
    "Cepheid": ["Anomolous", "Mult-mode", "Classical"],
    "Classical": ["Symmetrical", "Fundamental", "Overtone"],
    "microlensing": ["binary lens", "triple-system lens", "binary source"],
    "binary lens": ["lens with planet"],
}
# Other names that no rule gives. Case doesn't matter; the first class in the tree that has a name keeps it.
NAMES = {
    "DM annihilation": ["dark matter annihilation"], "Solar System Object": ["SSO"], "Tidal Disruption Event": ["TDE"], "AGN": ["Active Galactic Nuclei"], "Seyfert": ["Sy"],
    "QSO": ["Quasistellar Object"], "OVV": ["optically violent variable"], "gravitational lensing": ["lensing"],
    "compact merger": ["gravitational wave event"], "DNS": ["double neutron star", "NS-NS"], "kilonova": ["KN"], "NS-BH": ["NSBH"],
    "GRB": ["Gamma-ray bursts", "GRBs"], "short GRB": ["SHB", "sGRB"], "long GRB": ["LSB", "lGRB", "long-soft GRB"], "X-ray Flash": ["XRF", "XRFs"], "afterglow": ["GRB plateau"],
    "Supernova": ["SN", "sne", "supernovae"], "Ia": ["Ia-p"], "Ia-02cx": ["Iax", "SN Iax"], "Ia-CSM": ["interacting SN Ia", "2002ic-like", "SN Ia-02ic"],
    "Ia-03fg": ["super Chandra", "Ia-SC"], "Ib-pec": ["SN Ib-p", "Ib-p"], "Ibn": ["2006jc-like"], "Ic-BL": ["SN IcBL", "hypernova", "broad-lined supernova"],
    "Ic-SLSN": ["SLSN Type I", "SLSN-I", "super-luminous SN", "SLSN I"], "Ic.5-SLSN": ["SLSN Type I.5", "SLSN-I.5", "SLSN I.5"], "Ic-pec": ["SN Ic-p", "Ic-p"],
    "Ib/c": ["SN Ibc", "Ibc"], "II-norm": ["SN II", "SNII"], "IIP": ["SN II-P", "SN Type IIP"], "IIL": ["SN II-L", "SN Type IIL"], "IIb": ["SN II-b", "SN Type IIb"],
    "IIb-pec": ["SN II-bp", "SN Type IIb-pec"], "II-pec": ["SNIIp", "SN II-p", "SN Type IIp", "IIpec", "II-p"], "II-SLSN": ["SLSN Type II", "SLSN-II", "super-luminous SN-II", "SLSN II"],
    "FBOT": ["FELT"], "Ca-rich": ["Ca strong"], "Luminous Red Nova": ["LRN"],
    "Beta Lyrae": ["EB", "B Lyr"], "X-Ray Burster": ["XB", "XRay Burster"],
    "System with Planet(s)": ["EP", "System with planet", "Binary star system w/ planet", "Binary star system with planet", "Planetary transit"],
    "RS CVn": ["RS Canum Venaticorum", "RS Can Venat", "RS"], "W Ursae Maj": ["EW", "W Ursae Majoris", "W UMa"], "EWa": ["A-type W UMa", "W Uma a"], "EWw": ["W-type W UMa", "W UMa w"],
    "Algol": ["EA", "Algol-type", "Beta Persei-type", "Beta Per"], "HW Vir": ["HW Virginis"], "Symbiotic Var": ["Symbiotic Variable", "ZAND"], "NN Ser": ["NN Serpentis"], "Redback Pulsar": ["Redback"],
    "SX Ari": ["SXA", "SXARI", "SX Arietus", "helium variable"], "Alpha2 CVn": ["Alpha2 Canum Venaticorum", "ACV"], "Rapidly Oscillating": ["ACVO", "roAp"],
    "FK Comae Bern": ["FK Comae Berenices", "FKCom"], "Pulsar": ["PSR"], "BY Dra": ["BY", "BYDraconis"],
    "UV Ceti": ["UV", "Flare star", "UV Cet-type"], "S Doradus": ["S Dor", "SDor", "Luminous blue variable", "LBV"], "Wolf-Rayet": ["WR"], "Gamma Cas": ["Gamma Cassiopeiae", "GCas"],
    "R Cor Borealis": ["R Coronae Borealis", "RCB", "R CrB", "R Cor Bor"], "DY Per": ["DY Persei"], "YSO": ["young stellar object"], "FU Ori": ["FU", "FUor", "FU Orionis"],
    "Orion": ["IN"], "w/Abs": ["IN(YY)"], "T Tauri": ["TTS", "TT", "INT", "IT"], "TTc": ["Classical TTS", "Classical T Tauri"], "TTw": ["Weak-line TTS", "Weak-line T Tauri"],
    "Herbig AE/BE": ["HAeBe"], "FS CMa": ["FS Canis Majoris"],
    "Gamma Doradus": ["GDOR"], "SX Phe": ["SX Phoenicis", "SXPHE"], "RR Lyrae": ["RR Lyr", "RR variable", "RR", "cluster variable"], "Blazhko": ["RR Lyrae Blazhko", "RRBlazhko"],
    "Alpha Cygni": ["Alpha Cyg", "A Cyg", "ACYG"], "LPV": ["long-period variable", "cool giant/supergiant"], "Mira": ["M", "Long period variable"], "Semiregular": ["SR", "SRPV", "semi-regular"],
    "SRa/Z-Aquarii": ["SRA"], "OSARG": ["OGLE Small-Amplitude Red Giant"], "RV Tau": ["RV Tauri", "RV"], "Const Mean Mag": ["Constant mean magnitude"], "Var Mean Mag": ["Variable mean magnitude"],
    "Pulsating WD": ["Pulsating white dwarf"], "GW VIr": ["DOV", "Pulsating PG 1159"], "ZZ Ceti": ["DAV", "ZZ Cet"], "H abs only": ["H-WD"],
    "He abs only": ["DBV", "DB white dwarf", "V777 Her", "He-WD"], "Sun analogue": ["Sun analog", "Solar analogue", "Solar analog", "Solar-like"],
    "Delta Scuti": ["Delta Sct", "DSct", "dwarf cepheid", "DST"], "Low-Amp": ["LADS", "Low-amplitude delta Scuti"],
    "High-Amp": ["giant/main sequence", "HADS", "High-amplitude delta Scuti", "Al Velorum"], "PMS Delta Scuti": ["Pre-main sequence Delta Scuti"], "PV Telescopii": ["PVTEL", "PV Tel"],
    "Beta Cephei": ["BCep", "B Cep", "Beta Canis Majoris", "β Cephei"],
    "Population II Cepheid": ["Population II Ceph", "Type II Ceph", "Type II Cepheid", "Type-II Ceph", "Type-II Cepheid", "CW"], "BL Her": ["BL Herculis", "CWB"], "W Vir": ["W Virginis", "CWA"],
    "Cepheid": ["Cep"], "Anomolous": ["Anomolous Cepheid", "BLBOO"], "Mult-mode": ["Double-mode Cepheid", "Multi-mode Cepheid", "CEP(B)"],
    "Classical": ["Population I Cepheid", "Type I Cepheid", "DCEP", "Delta Cepheid", "Classical Cepheid"], "Symmetrical": ["DCEPS", "Delta Cep-type Symmetrical"],
    "Fundamental": ["F", "Fundamental mode"], "Overtone": ["O"], "SPB": ["53 Persei", "Slowly Pulsating B-type", "Slowly Pulsating B"], "BLAP": ["Blue Large-Amplitude Pulsator"],
}
Entry = tuple[str, list[str], list[str]]


def _by_rule(name: str) -> list[str]:
    """Other names of a supernova type: SN and SNe before it, those like a named supernova, and normal ones."""
    if name in ("Type I", "Type II"):
        return [f"SN {name}"]
    if not re.fullmatch(r"I{1,2}[abcdePLn]?(?:/c|n)?(?:-(?:pec|norm|CSM|BL|\d\d[a-zA-Z]+))?", name):
        return []
    out = [f"SN {name}", f"SN{name}"]
    if name in ("Ia", "Ib", "Ic", "IIn"):
        out += [f"SNe {name}", f"supernovae {name}"]
    if m := re.fullmatch(r"Ia-(\d\d)(\w+)", name):
        out.append(f"{'19' if m[1] > '50' else '20'}{m[1]}{m[2]}-like")
    if name.endswith("-norm"):
        out += [f"normal SN {name[:-5]}", f"{out[0]}al"]
    return out


@cache
def builtin() -> list[Entry]:
    """(class, path from the root, other names), parents before children, in the tree's order."""
    out: list[Entry] = []

    def go(name: str, above: list[str]) -> None:
        path = [*above, name]
        out.append((name, path, [*NAMES.get(name, ()), *_by_rule(name)]))
        for c in CHILDREN.get(name, ()):
            go(c, path)

    go(ROOT, [])
    return out


def load(folder: str, top: str = "top.yaml") -> list[Entry]:
    """Entries from YAML files: class, other names, and lists of classes below; {ref: file} stands for that file's class.

    A file that isn't there becomes a class named after it with -placeholder. The driver reads the folder.
    """
    import yaml  # only here: the built-in tables need none

    out: list[Entry] = []

    def read(file: str) -> Any:
        with open(Path(folder) / file, encoding="utf-8") as f:
            return yaml.safe_load(f)

    def go(node: Any, above: list[str]) -> None:
        if isinstance(node, list):
            for x in node:
                go(x, above)
        elif isinstance(node, dict) and "ref" in node:
            file = Path(folder) / node["ref"]
            go(read(node["ref"]) if file.exists() else {"class": f"{file.stem}-placeholder"}, above)
        elif isinstance(node, dict):
            path = above
            if isinstance(name := node.get("class"), str):
                path, more = [*above, name], node.get("other names")
                out.append((name, path, [str(a) for a in more] if isinstance(more, list) else []))
            for x in node.values():
                if isinstance(x, dict | list):
                    go(x, path)

    go(read(top), [])
    return out


def names_of(entries: list[Entry]) -> dict[str, str]:
    """Lower-case name -> class; the first to claim a name has it."""
    out: dict[str, str] = {}
    for name, _, more in entries:
        for a in (name, *more):
            out.setdefault(a.lower(), name)
    return out


def paths_of(entries: list[Entry]) -> dict[str, list[str]]:
    """Class -> path; the first place of a class counts."""
    out: dict[str, list[str]] = {}
    for name, path, _ in entries:
        out.setdefault(name, path)
    return out
