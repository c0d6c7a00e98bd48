"""Word lists that drive matching: user tables, small defaults, and the fixed values of the scoring rules."""

from __future__ import annotations

from dataclasses import dataclass, field

# Words and patterns that the scoring rules name. Results depend on each of them.
POSITIONAL = (
    "anterior", "posterior", "superior", "inferior", "ventral", "dorsal", "medial", "lateral", "rostral", "caudal",
    "oral", "dorsomedial", "ventromedial", "dorsolateral", "ventrolateral", "anteroposterior", "central",
)
DIRECTIONS = ("posterior", "ventral", "dorsal", "lateral", "medial", "caudal", "rostral", "oral")
STRUCTURE_GENERICS = ("nucleus", "nuclei", "ganglion", "ganglia")
LOBES = ("frontal", "parietal", "temporal", "occipital", "opercular")
STRUCTURE_CLASSES = {
    "gray": ("nucleus", "nuclei", "ganglion", "ganglia", "claustrum"),
    "white": (
        "tract", "fasciculus", "fascicle", "radiation", "stria", "striae", "commissure", "bundle", "capsule",
        "lemniscus", "path", "pathway", "fiber", "fibers", "fibre", "fibres",
    ),
    "nerve": ("nerve", "nerves"),
    "ventricle": ("ventricle", "ventricles"),
    "sulcus": ("sulcus", "sulci", "fissure", "fissures"),
    "organ": ("cochlea", "apparatus"),
    "cortex": ("cortex", "cortical", "gyrus", "gyri", "area", "areas"),
    "lobule": ("lobule", "lobules"),
}
REGION_ANCHORS = (
    "orbital", "occipital", "frontal", "temporal", "parietal", "insular", "cingulate", "hippocampal", "amygdaloid",
    "thalamic", "hypothalamic", "cerebellar",
)
PREFIXES = ("juxta", "retro", "supra", "infra", "peri", "para", "hypo", "hyper", "inter", "intra", "extra", "endo", "ecto", "meta", "proto", "pre", "sub")
SIDES = ("left", "right", "bilateral", "both", "ipsi", "contra", "ipsilateral", "contralateral")
RESIDUE_GENERICS = (
    "and", "or", "of", "the", "a", "an", "part", "parts", "division", "divisions", "zone", "zones", "region", "regions",
    "area", "areas", "nucleus", "nuclei", "complex", "group", "portion", "subregion",
)
GROUP_CUES = ("nuclei", "complex", "group", "region", "areas")
LEFT = ("left", "l", "lh", "lt", "ipsilateral")
RIGHT = ("right", "r", "rh", "rt", "contralateral")
BOTH = ("bilateral", "both", "b", "bl", "bilat")
MARKERS = (
    r"(?i)\b(?:ppp1r1b|rspo2|crf|mc4r|npy|sst|parvalbumin|somatostatin|calbindin|calretinin|"
    r"glutamatergic|gabaergic|dopaminergic|cholinergic|interneurons|interneuron|neurons|neuron|"
    r"cells|cell|spns?|d1r?|d2r?|vglut2?|vglut|glut2?|glut|cre|flp|aav)\b"
)
FUSED_MARKERS = r"(?i)(?<=\S)(?:vglut2?|glut2?|gabaergic|glutamatergic)(?=\s|$)"
CLEAR_LABEL = "Clear Label"
LABEL_LINE = r'"([^"]+)"\s*$'
KEY_LINE = r"^\d+:\s*(.*?)\s*(?:\([^)]*\))?\s*$"
AREA_ID = r"^([a-z]{0,3})(\d+)([a-z]{0,3})$"
ROMAN = r"^[ivxlcdm]+$"
LAYER_NAME = r"(?i)^L(?:[1-6]|I{1,3}|IV|V|VI)[A-Za-z]?$"
UNKNOWN_NAMES = ("", "<unknown>", "unknown", "n/a", "na", "none", "null")
LABELS = ("aligned", "broader_parent", "partial_or_narrower", "wrong", "ambiguous", "source_or_ontology_issue")
LABEL_ALIASES = {
    "exact": "aligned", "same": "aligned", "parent": "broader_parent", "broader": "broader_parent",
    "partial": "partial_or_narrower", "narrower": "partial_or_narrower",
    "ontology": "source_or_ontology_issue", "source": "source_or_ontology_issue",
}
LABEL_WORTH = {"aligned": 3, "broader_parent": 2, "partial_or_narrower": 1}
HARD_NOTES = (
    "fiber_tract", "white_matter", "cytoarchitectonic", "brodmann", "eponym", "laterality", "collective",
    "parenthetical", "disambiguation", "ambiguous", "issue",
)
MEDIUM_NOTES = ("abbrev", "abbreviation", "synonym", "compound", "modifier", "functional", "spelling", "variant")
KIND_NOTES = {
    "ambiguous": ("collective", "ambiguous", "disambiguation", "issue"),
    "edge": ("edge", "parenthetical", "plural", "spelling", "variant"),
    "synonym": ("synonym", "eponym", "functional"),
}
ALLO_WORDS = (
    "piriform", "entorhinal", "perirhinal", "parahippocamp", "olfactory cortex", "olfactory bulb",
    "anterior olfactory", "hippocamp", "dentate gyrus", "subiculum", "presubicul", "parasubicul", "indusium",
    "taenia tecta", "allocort", "mesocort",
)
ALLO_MORE = ("cerebellar cortex", "ectorhinal")
BORDER_WORDS = (
    "cingulate", "insula", "insular", "retrosplenial", "prostriata", "prefrontal", "prelimbic", "infralimbic",
    "orbitofrontal", "motor cortex", "somatosensory", "visual cortex", "auditory cortex", "parietal cortex",
    "temporal cortex", "neocortex", "isocortex", "primary motor", "primary visual", "primary somatosensory",
)
TOO_BROAD = (
    "cortex", "cerebral cortex", "brain", "cns", "central nervous system", "nervous system", "forebrain",
    "telencephalon", "contralateral cortex", "ipsilateral cortex", "whole brain", "brain tissue", "neural tissue",
)
LAYER_ONLY = r"(?i)^(?:L(?:[1-6]|I{1,3}|IV|V{1,2}|VI)[A-Za-z]?|layer\s*[1-6IVX]+|layers?\s*[1-6IVX]+(?:\s*/\s*[1-6IVX]+)?)$"
LAYER_TOKEN = r"(?i)(?:^|[^A-Za-z0-9])(?:L(?:[1-6]|I{1,3}|IV|V{1,2}|VI)[A-Za-z]?|layer\s*[1-6IVX]+|layers?\b)"
LAYER_CUT = r"(?i)(?:L(?:[1-6]|I{1,3}|IV|V{1,2}|VI)[A-Za-z]?|layer\s*[1-6IVX]+|layers?)"
CELL_MARKER = (
    r"(?i)(?:\b(?:neuron|neurons|interneuron|pyramidal|motoneuron|motoneurons|granule cell|purkinje|SST|PV\+|VIP\+|"
    r"NDNF|Rbp4|IT\b|CT\b|PT\b|cell type|cells?)\b)|(?:^[A-Za-z0-9]+\+)$"
)
FIBER = r"(?i)\b(?:tract|fasciculus|commissure|lemniscus|capsule|callosum|peduncle|radiation|bundle|fiber|fibre|white matter|nerve)\b"
COMPOUND = r"(?i)\b(?:and|/|&|\+|versus|vs\.?)\b|,\s*(?:and\s+)?[a-z]"
CRYPTIC = r"^[A-Za-z]{1,3}\d{0,2}[A-Za-z]?$"
GAP_NAMES = r"(?i)\bexcluding\b|\(excluding |whole brain|all regions|limbic system|brainstem\b"
# End of the fixed values.


@dataclass(frozen=True)
class Lexicon:
    """Token lists; each word of one kind. The defaults are a minimal English set of our own."""

    stopwords: tuple[str, ...] = ("the", "of", "and", "a", "an", "in", "to", "or")
    laterality: tuple[str, ...] = ("left", "right", "bilateral", "ipsilateral", "contralateral")
    weak: tuple[str, ...] = ("area", "region", "part", "zone", "complex", "group", "division")
    modifiers: tuple[str, ...] = field(default=(*POSITIONAL, "core", "shell", "limb"))

    @property
    def noncontent(self) -> tuple[str, ...]:
        words = {*self.laterality, *self.weak, *STRUCTURE_GENERICS, *(set(self.modifiers) & set(DIRECTIONS))}
        return tuple(sorted(words - set(LOBES)))

    @property
    def generic(self) -> tuple[str, ...]:
        return tuple(sorted({*self.stopwords, *self.weak, *self.laterality, *self.modifiers}))

    @property
    def residue(self) -> tuple[str, ...]:
        return tuple(sorted({*SIDES, *RESIDUE_GENERICS, *POSITIONAL, *self.laterality, *self.weak, *self.modifiers}))
