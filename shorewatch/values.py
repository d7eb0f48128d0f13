"""Fixed values of the compatible formats.

Sections marked as fixed hold data that existing rule packs, source annotations and report consumers already
rely on; those marked as defaults of this package are its own and can be changed.
"""

# -- fixed values: enumerations ---------------------------------------------
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "SAFE", "INFO"]
THREATS = [
    "classical-broken",
    "shor-broken",
    "grover-reduced",
    "grover-safe",
    "pqc-standardized",
    "pqc-experimental",
    "pqc-broken",
    "unknown",
]
PRIMITIVES = [
    "asymmetric-encryption",
    "key-exchange",
    "signature",
    "symmetric-cipher",
    "hash",
    "mac",
    "kdf",
    "rng",
    "aead",
    "other",
]
ACTIVE = "active"
EXEMPTED = "exempted"
EXPIRED = "expired-exemption"
VERDICTS = ["NON-COMPLIANT", "AT RISK", "COMPLIANT"]
FAIL_MODES = ["critical", "high", "any", "never"]

# -- fixed values: file selection -------------------------------------------
EXTENSIONS = {
    ".java": "java",
    ".py": "python",
    ".js": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".go": "go",
}
SKIPPED_DIRECTORIES = [
    ".git",
    "node_modules",
    "vendor",
    ".gradle",
    "target",
    "build",
    "dist",
    ".next",
    "__pycache__",
    ".cache",
    "out",
]

# -- fixed values: severity by threat and, where it matters, primitive --------
THREAT_SEVERITY = {
    "pqc-broken": "CRITICAL",
    "shor-broken": "HIGH",
    "classical-broken": "HIGH",
    "grover-reduced": "MEDIUM",
    "grover-safe": "INFO",
    "pqc-standardized": "INFO",
    "pqc-experimental": "LOW",
    "unknown": "MEDIUM",
}
HARVESTABLE_PRIMITIVES = ["asymmetric-encryption", "key-exchange"]
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "INFO": 0, "SAFE": 0}
LISTING_RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}
CONFIDENCE = 8

# -- defaults of this package: annotation marker, configuration file ------------
MARKER = "cryptoscan:ignore"
CONFIG_FILE = ".cryptoscan.yml"

# -- fixed values: annotation formats -------------------------------------------
MARKER_PATTERN = rf"{MARKER}\b"
ANNOTATION_RULE_PATTERN = r"\brule=([A-Za-z0-9._:/-]+)"
ANNOTATION_REASON_PATTERN = r"""\breason=(?:"([^"]*)"|'([^']*)'|(\S+))"""
ANNOTATION_UNTIL_PATTERN = r"\buntil=(\d{4}-\d{2}-\d{2})"

# -- fixed values: interchange report ------------------------------------------
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
SARIF_VERSION = "2.1.0"
SARIF_LEVEL = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning"}
CI_LEVEL = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning"}
PROPERTY_SCHEMA_VERSION = "1.0"
BASE_TAGS = ["security", "cryptography", "post-quantum"]

# -- defaults of this package: where report properties and fingerprints are kept ---
PROPERTY_NAMESPACE = "cryptoscan"
FINGERPRINT_KEY = "cryptoscan/v1"

# -- fixed values: display labels --------------------------------------------
THREAT_LABELS = {
    "shor-broken": "Shor-broken (CRQC)",
    "classical-broken": "Classically broken",
    "grover-reduced": "Grover-reduced",
    "grover-safe": "Grover-safe",
    "pqc-standardized": "PQC standardized",
    "pqc-experimental": "PQC experimental",
    "pqc-broken": "PQC broken",
}
SEVERITY_CLASSES = {
    "CRITICAL": "sev-critical",
    "HIGH": "sev-high",
    "MEDIUM": "sev-medium",
    "LOW": "sev-low",
}
VERDICT_CLASSES = {
    "NON-COMPLIANT": "badge-fail",
    "AT RISK": "badge-warn",
    "COMPLIANT": "badge-pass",
}
LOCAL_SOURCE_LABEL = "local scan"
NO_ALGORITHM = "n/a"

# Code points with the Unicode White_Space property, usable inside a character
# class of both java.util.regex and RE2.
SPACE_CLASS = (
    r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
