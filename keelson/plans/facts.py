"""What each detector should find, written down apart from the catalogue, for the SQL that checks it.

Fixed values, in the dialect of the checking engine: \\b and \\s are ASCII there, which is all that
the derived texts hold around secrets. Group 1 is what comes before the value, 2 the key, 3 the value.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Facts:
    id: str
    secret_type: str
    severity: str
    regex: str
    groups: str = ""  # of: before, key, value
    extensions: str = ""
    min_entropy: float = -1.0
    reject_placeholders: bool = False
    keywords: str = ""  # one a line

    def group(self, name: str) -> int | None:
        return {"before key value": {"before": 1, "key": 2, "value": 3}, "before value": {"before": 1, "value": 2}}.get(self.groups, {}).get(name)


CONFIG = ".json .config .xml .yaml .yml .env"
FACTS = (
    Facts("dotnet.connection_string.sql", "ConnectionString", "critical", r"""(?i)((Password|Pwd)\s*=\s*)([^;"'\r\n]{4,})""", "before key value", CONFIG + " .cs .ini", -1.0, True, "password\npwd"),
    Facts("dotnet.connection_string.json_key", "ConnectionString", "critical", r'(?i)("([A-Za-z0-9_]*connection[A-Za-z0-9_]*)"\s*:\s*")([^"]*(?:Password|Pwd)\s*=\s*[^";]{4,}[^"]*)"', "before key value", ".json .config .xml", -1.0, True, "connection\npassword=\npwd="),
    Facts("aws.access_key_id", "AwsAccessKey", "critical", r"\bAKIA[0-9A-Z]{16}\b", keywords="akia"),
    Facts("aws.temp_access_key_id", "AwsAccessKey", "critical", r"\bASIA[0-9A-Z]{16}\b", keywords="asia"),
    Facts("aws.role_access_key_id", "AwsAccessKey", "critical", r"\bAROA[0-9A-Z]{16}\b", keywords="aroa"),
    Facts("aws.secret_access_key", "AwsSecretAccessKey", "critical", r"""(?i)((aws_secret_access_key)\s*[:=]\s*["']?)([A-Za-z0-9/+=]{40})["']?""", "before key value", "", 4.0, True, "aws_secret_access_key"),
    Facts("github.classic_pat", "GitHubToken", "critical", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", keywords="ghp_\ngho_\nghu_\nghr_\nghs_"),
    Facts("github.fine_grained_pat", "GitHubToken", "critical", r"\bgithub_pat_[A-Za-z0-9_]{82}\b", keywords="github_pat_"),
    Facts("github.app_token", "GitHubToken", "high", r"\bghs_[A-Za-z0-9]{36,}\b", keywords="ghs_"),
    Facts("stripe.live_secret_key", "StripeKey", "critical", r"\bsk_live_[A-Za-z0-9]{24,99}\b", keywords="sk_live_"),
    Facts("stripe.restricted_key", "StripeKey", "critical", r"\brk_live_[A-Za-z0-9]{24,99}\b", keywords="rk_live_"),
    Facts("gitlab.pat", "GitLabToken", "critical", r"\bglpat-[A-Za-z0-9_\-]{20,99}\b", keywords="glpat-"),
    Facts("csharp.bearer_token_literal", "BearerToken", "high", r'("Bearer\s+)([A-Za-z0-9._\-]{30,})"', "before value", ".cs", 3.0, True, "bearer "),
    Facts("slack.token", "SlackToken", "high", r"\bxox[abprs]-[A-Za-z0-9-]{10,72}\b", keywords="xoxa-\nxoxb-\nxoxp-\nxoxr-\nxoxs-"),
    Facts("jwt.signing_key", "JwtSecret", "high", r'(?i)("([A-Za-z0-9_]*(?:JwtSecret|JwtSigningKey|TokenSecret|SigningKey|JwtKey)[A-Za-z0-9_]*)"\s*:\s*")([^"\\]{12,})"', "before key value", CONFIG, -1.0, True, "jwtsecret\njwtsigningkey\ntokensecret\nsigningkey\njwtkey"),
    Facts("azure.storage_account_key", "AzureStorageKey", "critical", r"(AccountKey\s*=\s*)([A-Za-z0-9+/]{86,88}==?)", "before value", keywords="accountkey="),
    Facts("crypto.private_key_pem", "PrivateKey", "critical", r"-----BEGIN(?:\s+[A-Z]+)?\s+PRIVATE KEY-----", keywords="private key-----"),
    Facts("generic.api_key", "ApiKey", "medium", r'(?i)("([A-Za-z0-9_-]*(?:ApiKey|api_key|X-Api-Key|api-key)[A-Za-z0-9_-]*)"\s*:\s*")([^"\\]{16,})"', "before key value", CONFIG, -1.0, True, "apikey\napi_key\nx-api-key\napi-key"),
    Facts("generic.password.config", "Password", "high", r'(?i)("([A-Za-z0-9_]*(?:Password|Passwd|Pwd)[A-Za-z0-9_]*)"\s*:\s*")([^"\\]{6,})"', "before key value", CONFIG, -1.0, True, "password\npasswd\npwd"),
)
HIGH_ENTROPY = Facts("generic.high_entropy", "HighEntropyString", "low", r'(")([A-Za-z0-9+/=_\-]{20,})"', "before value", CONFIG + " .cs", 4.5, True)
TOKEN = Facts("custom.token", "Token", "high", r'(token = ")([0-9a-f]{40})"', "before value", keywords="token")
KEYWORDS = sorted({k for f in FACTS for k in f.keywords.split("\n") if k})
