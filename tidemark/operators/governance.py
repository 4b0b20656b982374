"""Masking, access scopes and audit."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_values import FIELD_MAP, json_string, object_text, text, variant


@dataclass(frozen=True)
class MaskRule:
    """A pattern and its mask. ``needs`` is a literal that every match contains,
    if there is one: texts without it skip the pattern."""

    name: str
    regex: str
    mask: str
    needs: str = ""


# The default mask rules, first match wins.
DEFAULT_MASKS = (
    MaskRule("email", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "***@***.***", "@"),
    MaskRule("credit-card", r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b", "****-****-****-****"),
    MaskRule("phone", r"\+?[1-9]\d{7,14}", "***-***-****"),
    MaskRule("ssn", r"\d{3}-\d{2}-\d{4}", "***-**-****", "-"),
)

# \b between ASCII word characters; the JVM's own \b also counts other letters
_ASCII_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def _outside_escapes(regex: str, boundary: str) -> str:
    """The regex with each word boundary replaced."""
    return re.sub(r"\\(.)", lambda m: boundary if m.group(1) == "b" else m.group(0), regex, flags=re.DOTALL)


def _found(plain: Column, rule: MaskRule) -> Column:
    """Whether the rule's pattern occurs in the text, cheap tests first."""
    exact = _outside_escapes(rule.regex, _ASCII_BOUNDARY)
    found = plain.rlike(exact)
    if exact != rule.regex and "(?" not in rule.regex:
        # without its boundaries the pattern matches more and runs faster
        found = plain.rlike(_outside_escapes(rule.regex, "")) & found
    return F.contains(plain, F.lit(rule.needs)) & found if rule.needs else found


def mask_text(plain: Column, rules: Sequence[MaskRule] = DEFAULT_MASKS) -> Column:
    """A text as a whole replaced by the mask of the first rule found in it."""
    masked = F
    for rule in rules:
        masked = masked.when(_found(plain, rule), F.lit(rule.mask))
    return masked.otherwise(plain) if rules else plain


def _masked_json(value_json: Column, plain: Column, rules: Sequence[MaskRule]) -> Column:
    """The JSON string of a text, or of its mask; an unmasked text is not written anew."""
    masked = F
    for rule in rules:
        masked = masked.when(_found(plain, rule), json_string(F.lit(rule.mask)))
    return masked.otherwise(value_json) if rules else value_json


# canonical JSON holds no raw control characters, so these two can stand for escapes
_BACKSLASH, _QUOTE = "\x01", "\x02"


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _mask_nested(value_json: Column, rules: Sequence[MaskRule]) -> Column:
    """Mask the text values inside canonical JSON; names, numbers and all other text stay as they are.

    Cut at its quotes, the text alternates between structure and strings; a
    string is a name if the structure after it starts with a colon.
    """
    plain_quotes = F.replace(
        F.replace(value_json, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE)
    )

    def whole(part: Column) -> Column:
        return F.replace(F.replace(part, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))

    def masked(part: Column) -> Column:
        escaped = part.rlike(r"[\\\x01\x02]")
        quoted = F.concat(F.lit('"'), whole(part), F.lit('"'))
        decoded = F.when(escaped, text(quoted)).otherwise(part)
        return _with(decoded, lambda plain: _masked_json(quoted, plain, rules))

    def joined(parts: Column) -> Column:
        def piece(part: Column, i: Column) -> Column:
            is_string = i % 2 == 1
            is_name = F.get(parts, i + 1).startswith(":")
            return (
                F.when(~is_string, part)
                .when(is_name, F.concat(F.lit('"'), whole(part), F.lit('"')))
                .otherwise(masked(part))
            )

        return F.array_join(F.transform(parts, piece), "")

    return _with(F.split(plain_quotes, '"', -1), joined)


def _nested(value_json: Column) -> Column:
    return F.substring(value_json, 1, 1).isin("{", "[")


def mask_value(value_json: Column, rules: Sequence[MaskRule] = DEFAULT_MASKS) -> Column:
    """Mask canonical JSON of one value."""
    flat = F.when(
        F.substring(value_json, 1, 1) == '"', _masked_json(value_json, text(value_json), rules)
    ).otherwise(value_json)
    return F.when(_nested(value_json), _mask_nested(value_json, rules)).otherwise(flat)


def mask_payload(events: DataFrame, rules: Sequence[MaskRule] = DEFAULT_MASKS, column: str = "payload") -> DataFrame:
    """Replace text values of a JSON column in which a rule's pattern is found.

    Everything is a native expression inside the row; numbers keep every digit.
    Text that is not JSON stays as it is. Results are canonical JSON.
    """
    # each step is a column of its own, so JSON is parsed and texts decoded once
    staged = events.withColumn("__variant", variant(column))
    staged = staged.withColumns(
        {
            "__canonical": F.to_json("__variant"),
            "__cells": F.transform(
                F.map_entries(F.try_variant_get("__variant", "$", FIELD_MAP)),
                lambda e: F.struct(
                    e["key"].alias("key"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("value_json")
                ),
            ),
        }
    )
    staged = staged.withColumns(
        {
            "__nested": F.coalesce(F.exists("__cells", lambda e: _nested(e["value_json"])), F.lit(False))
            | F.coalesce(F.col("__canonical").startswith("["), F.lit(False)),
            "__texts": F.transform(
                "__cells",
                lambda e: F.struct(
                    e["key"].alias("key"), e["value_json"].alias("value_json"), text(e["value_json"]).alias("plain")
                ),
            ),
        }
    )
    flat = object_text(
        F.transform(
            "__texts",
            lambda e: F.struct(
                e["key"].alias("key"),
                F.when(F.substring(e["value_json"], 1, 1) == '"', _masked_json(e["value_json"], e["plain"], rules))
                .otherwise(e["value_json"])
                .alias("value_json"),
            ),
        )
    )
    canonical = F.col("__canonical")
    bare = F.when(
        canonical.startswith('"'), _masked_json(canonical, text(canonical), rules)
    ).otherwise(canonical)
    masked = (
        F.when(canonical.isNull(), F.col(column))
        .when(F.col("__nested"), _mask_nested(canonical, rules))
        .when(F.col("__texts").isNotNull(), flat)
        .otherwise(bare)
    )
    return staged.select(*[masked.alias(c) if c == column else F.col(c) for c in events.columns])


def mask_transitions(changes: DataFrame, rules: Sequence[MaskRule] = DEFAULT_MASKS) -> DataFrame:
    """Mask both sides of field diffs, after the diff was taken."""
    return changes.withColumns(
        {"old_json": mask_value(F.col("old_json"), rules), "new_json": mask_value(F.col("new_json"), rules)}
    )


def mask_state(state: DataFrame, rules: Sequence[MaskRule] = DEFAULT_MASKS) -> DataFrame:
    """Mask a long-form state (also that of anomalies, see ``attach_states``)."""
    return state.withColumn("value_json", mask_value(F.col("value_json"), rules))


def reveal_events(
    events: DataFrame, requests: DataFrame, at: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Unmasked events for ``requests(aggregate_id, sequence_number, user_id, reason)``, and audit rows.

    A request needs a reason; of several events under one key the last one
    counts. The audit outcome says whether the event was found.
    """
    valid = requests.filter(F.trim(F.coalesce("reason", F.lit(""))) != "")
    key = ["aggregate_id", "sequence_number"]
    asked = valid.select(*key).distinct()
    rest = [c for c in events.columns if c not in key]
    found = (
        events.join(asked, key, "left_semi")
        .groupBy(*key)
        .agg(F.max_by(F.struct(*rest), F.struct("global_position", "event_id")).alias("__event"))
    )
    revealed = valid.join(found, key).select(*requests.columns, "__event.*")
    audit = valid.join(found.select(*key, F.lit(True).alias("__found")), key, "left").select(
        F.lit("REVEAL_PII").alias("action"),
        F.lit("EVENT").alias("resource_type"),
        F.concat("aggregate_id", F.lit("#"), F.col("sequence_number").cast("string")).alias("resource_id"),
        "user_id",
        F.to_json(
            F.struct("reason", F.coalesce("__found", F.lit(False)).alias("found"))
        ).alias("details_json"),
        (F.current_timestamp() if at is None else at).alias("created_at"),
    )
    return revealed, audit


# Permissions and decision reasons.
PERMISSIONS = (
    "SEARCH_AGGREGATES", "VIEW_RECENT_EVENTS", "VIEW_AGGREGATE_TYPES", "VIEW_TIMELINE", "VIEW_REPLAY",
    "VIEW_ANOMALIES", "EXPORT_AGGREGATE", "START_EXPORT", "REVEAL_PII", "VIEW_DATASOURCES", "VIEW_PLUGINS",
    "VIEW_STATISTICS", "VIEW_METRICS", "VIEW_AUDIT_LOG", "MANAGE_API_KEYS", "VIEW_OPENAPI", "EXECUTE_BISECT",
)
ALLOW, AUTH_REQUIRED, MISSING_PERMISSION, SOURCE_SCOPE, TYPE_SCOPE = (
    "ALLOW", "DENY_AUTH_REQUIRED", "DENY_MISSING_PERMISSION", "DENY_SOURCE_SCOPE", "DENY_AGGREGATE_TYPE_SCOPE",
)


def permission_name(value: str | None) -> str:
    return (value or "").strip().upper().replace("-", "_").replace(" ", "_")


@dataclass(frozen=True)
class Role:
    """Permissions of a role and the sources and aggregate types it covers (none = all)."""

    id: str
    permissions: Sequence[str] = ()
    allowed_sources: Sequence[str] = ()
    allowed_aggregate_types: Sequence[str] = ()

    def grants(self, permission: str) -> bool:
        return permission_name(permission) in {permission_name(p) for p in self.permissions}


@dataclass(frozen=True)
class Policy:
    """The access configuration: a handful of roles, written into the plan as literals."""

    enabled: bool = True
    roles: Sequence[Role] = ()
    default_roles: Sequence[str] = ()
    principal_roles: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def roles_of(self, user_id: str, own: Iterable[str] = ()) -> list[Role]:
        ids = {*own, *self.default_roles, *self.principal_roles.get(user_id, ())}
        return [r for r in self.roles if r.id in ids]


def _in_scope(allowed: Sequence[str], value: Column) -> Column:
    if not allowed:
        return F.lit(True)
    blank = value.isNull() | (F.trim(value) == "")
    return blank | F.lower(value).isin([a.lower() for a in allowed])


def scope_filter(
    events: DataFrame,
    policy: Policy,
    user_id: str | None,
    permission: str,
    roles: Iterable[str] = (),
    source_column: str = "source_id",
) -> DataFrame:
    """The events a principal may see; a plain filter, so it reaches the scan."""
    if not policy.enabled:
        return events
    allowed = F.lit(False)
    for role in policy.roles_of(user_id, roles) if user_id else []:
        if role.grants(permission):
            source = F.col(source_column) if source_column in events.columns else F.lit(None).cast("string")
            allowed = allowed | (
                _in_scope(role.allowed_sources, source)
                & _in_scope(role.allowed_aggregate_types, F.col("aggregate_type"))
            )
    return events.filter(allowed)


def authorize_requests(requests: DataFrame, policy: Policy) -> DataFrame:
    """Decision and reason for ``requests(user_id, roles, permission, source_id, aggregate_type)``.

    A NULL user is not signed in. Denials name the missing permission first,
    then the source, then the aggregate type.
    """
    if not policy.enabled:
        return requests.withColumns({"allowed": F.lit(True), "reason": F.lit(ALLOW)})
    permission = F.translate(F.upper(F.trim("permission")), "- ", "__")
    permitted = F.lit(False)
    full = F.lit(False)
    by_source = F.lit(False)
    for role in policy.roles:
        users = [u for u, ids in policy.principal_roles.items() if role.id in ids]
        holds = (
            F.lit(role.id in policy.default_roles)
            | F.coalesce(F.array_contains("roles", role.id), F.lit(False))
            | F.col("user_id").isin(users)
        )
        granted = holds & permission.isin([permission_name(p) for p in role.permissions])
        source = _in_scope(role.allowed_sources, F.col("source_id"))
        kind = _in_scope(role.allowed_aggregate_types, F.col("aggregate_type"))
        permitted = permitted | granted
        by_source = by_source | (granted & ~source)
        full = full | (granted & source & kind)
    reason = (
        F.when(F.col("user_id").isNull(), AUTH_REQUIRED)
        .when(full, ALLOW)
        .when(~F.coalesce(permitted, F.lit(False)), MISSING_PERMISSION)
        .when(by_source, SOURCE_SCOPE)
        .otherwise(TYPE_SCOPE)
    )
    decided = requests.withColumn("reason", reason)
    return decided.withColumn("allowed", F.col("reason") == ALLOW)


# Rows of an audit listing, and the columns of a record.
DEFAULT_AUDIT = 50
AUDIT_COLUMNS = [
    "action", "resource_type", "resource_id", "user_id", "auth_method", "client_ip", "request_id",
    "user_agent", "details_json", "created_at",
]


def append_audit(records: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Append audit records by day; nothing is ever rewritten."""
    complete = records
    for column in AUDIT_COLUMNS:
        if column not in records.columns:
            complete = complete.withColumn(column, F.lit(None).cast("string"))
    dated = complete.select(*AUDIT_COLUMNS, F.to_date("created_at").alias("day"))
    dated.write.mode("append").partitionBy("day").format(file_format).save(path)


def recent_audit(
    audit: DataFrame, limit: int | None = None, action: str | None = None, user_id: str | None = None
) -> DataFrame:
    """Newest audit rows first, optionally of one action or user."""
    if action is not None:
        audit = audit.filter(F.col("action") == action)
    if user_id is not None:
        audit = audit.filter(F.col("user_id") == user_id)
    size = DEFAULT_AUDIT if limit is None else max(1, limit)
    ties = [F.desc(c) for c in ("audit_id", "resource_id") if c in audit.columns]
    return audit.orderBy(F.desc("created_at"), *ties).limit(size)
