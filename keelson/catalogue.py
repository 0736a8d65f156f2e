"""Detectors: what is searched for, where, and how a match is judged."""

from __future__ import annotations

from dataclasses import dataclass

SEVERITIES = ("low", "medium", "high", "critical")


def severity_rank(severity: str) -> int:
    """0 for low to 3 for critical; any case. Numbers and other names are refused."""
    try:
        return SEVERITIES.index(severity.lower())
    except ValueError:
        raise ValueError(f"unknown severity {severity!r}") from None


@dataclass(frozen=True)
class Detector:
    """One pattern. Group 1 of regex is all that comes before the value, unless value_group is 0."""

    id: str
    secret_type: str
    severity: str
    regex: str
    key_group: int | None = None
    value_group: int = 0
    extensions: tuple[str, ...] = ()
    min_entropy: float | None = None
    reject_placeholders: bool = False
    keywords: tuple[str, ...] = ()
    suggested_fix: str = ""
    #: Each match holds one of the keywords and no line feed: only lines with a keyword are looked at.
    one_line: bool = False


# Building blocks of the expressions below: a word character as of Unicode, word edges, white space
_W = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]"
_B, _E = f"(?<!{_W})", f"(?!{_W})"
_G = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
_S = r"[\s\u0085\p{Z}]"
_K = "[A-Za-z0-9_]*"

# Ids, types, severities, expressions, extensions, keywords and advice
_CONFIG = (".json", ".config", ".xml", ".yaml", ".yml", ".env")
DETECTORS: tuple[Detector, ...] = (
    Detector("dotnet.connection_string.sql", "ConnectionString", "critical", f"(?i)((Password|Pwd){_S}*={_S}*)([^;\"'\\r\\n]{{4,}})", 2, 3, (*_CONFIG, ".cs", ".ini"), None, True, ("Password", "Pwd"), "Move to dotnet user-secrets or Azure Key Vault. See https://learn.microsoft.com/aspnet/core/security/app-secrets"),
    Detector("dotnet.connection_string.json_key", "ConnectionString", "critical", f'(?i)("({_K}connection{_K})"{_S}*:{_S}*")([^"]*(?:Password|Pwd){_S}*={_S}*[^";]{{4,}}[^"]*)"', 2, 3, (".json", ".config", ".xml"), None, True, ("Connection", "Password=", "Pwd="), "Move to dotnet user-secrets or Azure Key Vault. See https://learn.microsoft.com/aspnet/core/security/app-secrets"),
    Detector("aws.access_key_id", "AwsAccessKey", "critical", f"{_B}AKIA[0-9A-Z]{{16}}{_E}", keywords=("AKIA",), suggested_fix="Rotate the access key in IAM. Use IAM roles, environment variables, or AWS SSO instead. See https://docs.aws.amazon.com/IAM/latest/UserGuide/best-practices.html", one_line=True),
    Detector("aws.temp_access_key_id", "AwsAccessKey", "critical", f"{_B}ASIA[0-9A-Z]{{16}}{_E}", keywords=("ASIA",), suggested_fix="Even though temporary, treat as compromised — revoke the issuing role's session.", one_line=True),
    Detector("aws.role_access_key_id", "AwsAccessKey", "critical", f"{_B}AROA[0-9A-Z]{{16}}{_E}", keywords=("AROA",), suggested_fix="Investigate the role; rotate any associated long-term credentials.", one_line=True),
    Detector("aws.secret_access_key", "AwsSecretAccessKey", "critical", f"(?i)((aws_secret_access_key){_S}*[:=]{_S}*[\"']?)([A-Za-z0-9/+=]{{40}})[\"']?", 2, 3, (), 4.0, True, ("aws_secret_access_key",), "Rotate the IAM credential immediately. Move to env vars or AWS SSO."),
    Detector("github.classic_pat", "GitHubToken", "critical", f"{_B}gh[pousr]_[A-Za-z0-9]{{36,}}{_E}", keywords=("ghp_", "gho_", "ghu_", "ghr_", "ghs_"), suggested_fix="Revoke the token at https://github.com/settings/tokens and rotate.", one_line=True),
    Detector("github.fine_grained_pat", "GitHubToken", "critical", f"{_B}github_pat_[A-Za-z0-9_]{{82}}{_E}", keywords=("github_pat_",), suggested_fix="Revoke the token in GitHub settings and rotate.", one_line=True),
    Detector("github.app_token", "GitHubToken", "high", f"{_B}ghs_[A-Za-z0-9]{{36,}}{_E}", keywords=("ghs_",), suggested_fix="Rotate the GitHub App private key; the installation token derives from it.", one_line=True),
    Detector("stripe.live_secret_key", "StripeKey", "critical", f"{_B}sk_live_[A-Za-z0-9]{{24,99}}{_E}", keywords=("sk_live_",), suggested_fix="Roll the key in the Stripe dashboard immediately.", one_line=True),
    Detector("stripe.restricted_key", "StripeKey", "critical", f"{_B}rk_live_[A-Za-z0-9]{{24,99}}{_E}", keywords=("rk_live_",), suggested_fix="Roll the key in the Stripe dashboard.", one_line=True),
    Detector("gitlab.pat", "GitLabToken", "critical", f"{_B}glpat-[A-Za-z0-9_\\-]{{20,99}}{_G}", keywords=("glpat-",), suggested_fix="Revoke and rotate the token in GitLab settings.", one_line=True),
    Detector("csharp.bearer_token_literal", "BearerToken", "high", f'("Bearer{_S}+)([A-Za-z0-9._\\-]{{30,}})"', None, 2, (".cs",), 3.0, True, ("Bearer ",), "Read the token from configuration, an environment variable, or a secret manager."),
    Detector("slack.token", "SlackToken", "high", f"{_B}xox[abprs]-[A-Za-z0-9-]{{10,72}}{_G}", keywords=("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), suggested_fix="Rotate the Slack token in the app management console.", one_line=True),
    Detector("jwt.signing_key", "JwtSecret", "high", f'(?i)("({_K}(?:JwtSecret|JwtSigningKey|TokenSecret|SigningKey|JwtKey){_K})"{_S}*:{_S}*")([^"\\\\]{{12,}})"', 2, 3, _CONFIG, None, True, ("JwtSecret", "JwtSigningKey", "TokenSecret", "SigningKey", "JwtKey"), "Move the signing key to a secret manager and rotate."),
    Detector("azure.storage_account_key", "AzureStorageKey", "critical", f"(AccountKey{_S}*={_S}*)([A-Za-z0-9+/]{{86,88}}==?)", None, 2, keywords=("AccountKey=",), suggested_fix="Regenerate the key in the Azure portal; prefer Managed Identity or SAS tokens."),
    Detector("crypto.private_key_pem", "PrivateKey", "critical", f"-----BEGIN(?:{_S}+[A-Z]+)?{_S}+PRIVATE KEY-----", keywords=("PRIVATE KEY-----",), suggested_fix="Move to an HSM or secret manager. Treat the key as compromised and rotate."),
    Detector("generic.api_key", "ApiKey", "medium", f'(?i)("([A-Za-z0-9_-]*(?:ApiKey|api_key|X-Api-Key|api-key)[A-Za-z0-9_-]*)"{_S}*:{_S}*")([^"\\\\]{{16,}})"', 2, 3, _CONFIG, None, True, ("ApiKey", "api_key", "X-Api-Key", "api-key"), "Move to a secret manager or environment variable."),
    Detector("generic.password.config", "Password", "high", f'(?i)("({_K}(?:Password|Passwd|Pwd){_K})"{_S}*:{_S}*")([^"\\\\]{{6,}})"', 2, 3, _CONFIG, None, True, ("Password", "Passwd", "Pwd"), "Move to dotnet user-secrets, an environment variable, or Azure Key Vault."),
)
HIGH_ENTROPY = Detector("generic.high_entropy", "HighEntropyString", "low", '(")([A-Za-z0-9+/=_\\-]{20,})"', None, 2, (".cs", *_CONFIG), 4.5, True, (), "Review whether this string is a secret; if so, move to a secret manager.")
PLACEHOLDERS = "changeme change-me your-secret-here your-key-here your-password-here todo tbd placeholder <secret> <password> <key> *** xxxx xxxxx xxxxxx enter-your-key example sample dummy fake test null none".split()
DEFAULT_EXCLUDES = "**/bin/** **/obj/** **/.git/** **/node_modules/** **/.vs/** **/.vscode/** **/.idea/** **/TestResults/** **/wwwroot/lib/**".split()
GENERATED_EXCLUDES = "**/*.Designer.cs **/*.g.cs **/*.g.i.cs **/*.AssemblyInfo.cs **/Migrations/*.cs".split()
BINARY_EXTENSIONS = ".dll .exe .pdb .so .dylib .png .jpg .jpeg .gif .bmp .ico .webp .pfx .snk .p12 .cer .crt .der .zip .7z .tar .gz .bz2 .xz .nupkg .wasm .woff .woff2 .ttf .otf .pdf .mp3 .mp4 .mov .avi".split()
SCHEMA_VERSION, TOOL_VERSION, REDACTED_AUTHOR, MASK, MESSAGE_FILE = "1", "1.0.0", "[redacted]", "***", "<commit-message>"


def library(high_entropy: bool = False, least: str = "low") -> tuple[Detector, ...]:
    """Detectors of at least this severity: severity belongs to a detector, so the filter is settled before anything is read."""
    return tuple(d for d in DETECTORS + ((HIGH_ENTROPY,) if high_entropy else ()) if severity_rank(d.severity) >= severity_rank(least))


def keywords(detectors: tuple[Detector, ...]) -> list[str]:
    """Distinct keywords, case ignored."""
    return sorted({k.lower() for d in detectors for k in d.keywords})
