"""DuckDB SQL with the results the registered queries must have."""

from __future__ import annotations

from patchlake import rules
from patchlake.plans.bindings import with_bindings


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _word(keyword: str) -> str:
    return _quoted(rf"\b{keyword}\b")


# Every keyword is tried on its own here, one regular expression each.
NORMAL = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
MESSAGE = NORMAL.format("coalesce(subject, '') || ' ' || coalesce(body, '')")


def _found(words: list[str]) -> str:
    return "[" + ", ".join(f"case when regexp_matches(t, {_word(w)}) then {_quoted(w)} end" for w in words) + "]"


STRONG = _found(rules.STRONG_KEYWORDS)
AGAINST = "[" + ", ".join(f"case when contains(t, {_quoted(w)}) then {_quoted('negative:' + w)} end" for w in rules.NEGATIVE_SUBSTRINGS) + "]"
EVIDENCE = "(" + " or ".join(f"contains(t, {_quoted(w)})" for w in rules.TEST_EVIDENCE_SUBSTRINGS) + ")"
REFERENCE = f"regexp_matches(t, {_quoted(rules.REFERENCE_PATTERN)})"


def _signal(test: str, negatives: bool) -> str:
    against = AGAINST if negatives else "[null]::varchar[]"
    return f"""
  select *, cast(2 * len(strong) - 3 * len(against) + 2 * len(extra) as int) as score,
         array_to_string(list_sort(list_concat(strong, against, extra)), ',') as signals
  from (select *, list_filter({STRONG}, lambda x: x is not null) as strong,
               list_filter({against}, lambda x: x is not null) as against,
               list_filter([case when {REFERENCE} then 'issue_or_pr_reference' end,
                            case when {test} and {EVIDENCE} then 'bug_related_test' end], lambda x: x is not null) as extra
        from (select *, {MESSAGE} as t from commits))"""


POSITIVE_SIGNAL = _signal("contains(t, 'test')", True)
NEGATIVE_SIGNAL = _signal(f"regexp_matches(t, {_quoted(rules.TEST_WORD_PATTERN)})", False)
INTENT = "(" + " or ".join(f"regexp_matches(t, {_quoted(p)})" for p in rules.EXPLICIT_INTENT_PATTERNS) + ")"
ROUTINE = "(" + " + ".join(f"cast(regexp_matches(t, {_word(w)}) as int)" for w in rules.ROUTINE_KEYWORDS) + ")"
LABEL = "(" + " or ".join(f"regexp_matches(lower(subject), {_word(w)})" for w in rules.LABEL_KEYWORDS) + ")"
LABEL_OF_CHANGE = LABEL.replace("lower(subject)", "lower(message)")

IGNORED = "(" + " or ".join(f"regexp_matches({{0}}, {_quoted(p)}, 'i')" for p in rules.IGNORED_PATH_PATTERNS) + ")"
SUFFIX = r"lower(regexp_extract({0}, '[^/](\.[^./]+)/*$', 1))"
SOURCE = SUFFIX + " in (" + ", ".join(_quoted(e) for e in rules.SOURCE_EXTENSIONS) + ")"
IS_TEST = "(contains(lower({0}), '/test/') or contains(lower({0}), '/tests/') or starts_with(lower({0}), 'test/') or starts_with(lower({0}), 'tests/') or starts_with(lower({0}), 'test_') or ends_with(lower({0}), '_test.py'))"

BREAK = r"'\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'"


def _lines(text: str, mark: str) -> str:
    kept = f"list_filter(string_split_regex({text}, {BREAK}), lambda l: starts_with(l, '{mark}') and not starts_with(l, '{mark * 3}'))"
    return f"list_transform({kept}, lambda l: substr(l, 2))"

ORACLE: dict[str, str] = {}




ORACLE["q_history_features"] = with_bindings(["file_changes"], """
with h as (
  select commit_hash, file_path, timestamp as ts, author_name, insertions, deletions,
         case when regexp_matches(lower(message), 'fix|bug|error|crash|regression|failure|broken|incorrect') then 1 else 0 end as bug
  from file_changes where parent_count > 0
),
p as (select distinct file_path, ts from h),
f as (
  select p.file_path, p.ts, count(h.ts) as n, coalesce(sum(bug), 0) as bugs, coalesce(sum(insertions), 0) as ins,
         coalesce(sum(deletions), 0) as del, count(distinct author_name) as authors, max(h.ts) as last
  from p left join h on h.file_path = p.file_path and h.ts < p.ts group by 1, 2
)
select h.commit_hash, h.file_path,
       cast(n as bigint) as prior_commit_count, cast(bugs as bigint) as prior_bug_fix_count,
       cast(ins as bigint) as prior_total_insertions, cast(del as bigint) as prior_total_deletions,
       cast(ins + del as bigint) as prior_total_churn, cast(authors as bigint) as prior_unique_authors,
       cast(coalesce(floor((epoch_us(h.ts) - epoch_us(last)) / 86400000000.0), -1) as bigint) as days_since_last_change,
       case when n = 0 then 0.0 else round(cast(bugs as double) / n, 6) end as historical_bug_fix_ratio,
       case when n = 0 then 0.0 else round(cast(ins + del as double) / n, 6) end as average_prior_churn
from h join f using (file_path, ts)
""")

ORACLE["q_history_events"] = """
with e as (select event_id, ts, cast(user_id as varchar) as u, event_type, cast(floor(value) as bigint) as v from events),
f as (
  select p.event_id, count(h.ts) as n, coalesce(count(*) filter (h.event_type = 'error'), 0) as bugs, coalesce(sum(h.v), 0) as ins,
         count(distinct h.event_type) as authors, max(h.ts) as last
  from e p left join e h on h.u = p.u and h.ts < p.ts group by 1
)
select e.event_id, e.u as "user",
       cast(n as bigint) as prior_commit_count, cast(bugs as bigint) as prior_bug_fix_count,
       cast(ins as bigint) as prior_total_insertions, cast(0 as bigint) as prior_total_deletions,
       cast(ins as bigint) as prior_total_churn, cast(authors as bigint) as prior_unique_authors,
       cast(coalesce(floor((epoch_us(ts) - epoch_us(last)) / 86400000000.0), -1) as bigint) as days_since_last_change,
       case when n = 0 then 0.0 else round(cast(bugs as double) / n, 6) end as historical_bug_fix_ratio,
       case when n = 0 then 0.0 else round(cast(ins as double) / n, 6) end as average_prior_churn
from e join f using (event_id)
"""

ORACLE["q_commit_totals"] = with_bindings(["commits", "numstat"], """
select c.commit_hash, repo_id, parent_count, coalesce(f, 0) as files_changed, cast(coalesce(i, 0) as bigint) as insertions,
       cast(coalesce(d, 0) as bigint) as deletions
from commits c left join (select commit_hash, count(*) as f, sum(insertions) as i, sum(deletions) as d from numstat group by 1) using (commit_hash)
""")

ORACLE["q_file_change_history"] = with_bindings(["commits", "numstat"], """
with n as (
  select *, flag = 'R' as renamed, flag = 'N' and deletions > insertions as deleted from numstat
),
paths as (select *, case when deleted then 'old/' || file_path else file_path end as path from n),
counts as (select commit_hash, file_path, insertions, deletions from n where not renamed)
select p.commit_hash, c.author, p.path as file_path, 'old/' || p.file_path as old_path,
       case when p.flag = 'A' then 'added' when p.deleted then 'deleted' when p.renamed then 'renamed' else 'modified' end as change_type,
       coalesce(k.insertions, 0) as insertions, coalesce(k.deletions, 0) as deletions,
       coalesce(k.insertions, 0) + coalesce(k.deletions, 0) as total_changes
from paths p join commits c on c.commit_hash = p.commit_hash and c.parent_count > 0
left join counts k on k.commit_hash = p.commit_hash and k.file_path = p.path
""")

_FILE_PATCHES = f"""
fp as (
  select d.commit_hash, c.author as author_name, c.subject as message, coalesce(new_path, old_path) as file_path,
         case when added then 'added' when deleted then 'deleted' when renamed then 'renamed' else 'modified' end as change_type,
         false as patch_truncated, patch
  from file_patches d join commits c on c.commit_hash = d.commit_hash and c.parent_count > 0
)"""
_LINE_COUNTS = f"cast(len({_lines('patch', '+')}) as int) as added_line_count, cast(len({_lines('patch', '-')}) as int) as removed_line_count"

ORACLE["q_file_patch_history"] = with_bindings(["commits", "file_patches"], f"""
with {_FILE_PATCHES}
select commit_hash, file_path, change_type, patch_truncated, {_LINE_COUNTS}, md5(patch) as patch_md5,
       md5(array_to_string({_lines('patch', '-')}, chr(10))) as removed_md5 from fp
""")

ORACLE["q_fix_patches"] = with_bindings(["commits", "file_patches"], f"""
with {_FILE_PATCHES}
select commit_hash, author_name, message, file_path, change_type, {_LINE_COUNTS}, 'bug_fix' as label from fp where {LABEL_OF_CHANGE}
""")

ORACLE["q_signal_score_pos"] = with_bindings(["commits"], f"select commit_hash, score, signals from ({POSITIVE_SIGNAL})")
ORACLE["q_signal_score_neg"] = with_bindings(["commits"], f"select commit_hash, score, signals from ({NEGATIVE_SIGNAL})")
ORACLE["q_intent_routine"] = with_bindings(["commits"], f"""
select commit_hash, {INTENT} as explicit, {ROUTINE} as routine from (select *, {MESSAGE} as t from commits)
""")
ORACLE["q_keyword_label"] = with_bindings(["commits"], f"select commit_hash, cast({LABEL} as int) as label from commits")
ORACLE["q_keyword_substring"] = with_bindings(["commits"], """
select commit_hash, regexp_matches(lower(subject), 'fix|bug|error|crash|regression|failure|broken|incorrect') as fix_like from commits
""")

# In DuckDB a word border is ASCII only, so it is spelled out for these texts.
_BEFORE, _AFTER = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"
_DOC_TESTS = [
    (r"^\s*the\b", rf"^\s*the{_AFTER}"),
    (r"\blicense\b", f"{_BEFORE}license{_AFTER}"),
    (r"\bthe\b", f"{_BEFORE}the{_AFTER}"),
    (r"\bla\b", f"{_BEFORE}la{_AFTER}"),
    (r"\bund\b", f"{_BEFORE}und{_AFTER}"),
    (r"\bof the\b", f"{_BEFORE}of the{_AFTER}"),
    (r"#\d+", r"#\d+"),
]
ORACLE["q_doc_pattern_counts"] = f"""
select doc_id, case {' '.join(f"when regexp_matches(t, {_quoted(q)}) then {_quoted(p)}" for p, q in _DOC_TESTS)} end as first_pattern,
       {' + '.join(f"cast(regexp_matches(t, {_quoted(q)}) as int)" for _, q in _DOC_TESTS)} as patterns, cast(length(t) as int) as chars
from (select doc_id, {NORMAL.format('text')} as t from documents)
"""

_PATH = "file_path"
ORACLE["q_path_flags"] = with_bindings(["numstat"], f"""
select commit_hash, file_path, {IGNORED.format(_PATH)} as ignored, {SOURCE.format(_PATH)} as source, {SUFFIX.format(_PATH)} = '.py' as python,
       case when {SUFFIX.format(_PATH)} = '' then 'no_extension' else {SUFFIX.format(_PATH)} end as extension, {IS_TEST.format(_PATH)} as test
from numstat
""")
ORACLE["q_language_histogram"] = with_bindings(["numstat"], """
select case when ends_with(file_path, '.py') then 'python' when ends_with(file_path, '.js') then 'javascript' end as language, count(*) as files
from (select distinct file_path from numstat) where ends_with(file_path, '.py') or ends_with(file_path, '.js') group by 1
""")

ORACLE["q_stored_patch"] = with_bindings(["patches"], f"""
with c as (select doc_id, length(patch) > {rules.STORED_PATCH_CHARS} as patch_truncated, substr(patch, 1, {rules.STORED_PATCH_CHARS}) as patch from patches)
select doc_id, patch_truncated, cast(length(patch) as int) as chars, md5(patch) as patch_md5 from c
""")
ORACLE["q_patch_lines"] = with_bindings(["patches"], f"""
with l as (select doc_id, {_lines('patch', '+')} as a, {_lines('patch', '-')} as r from patches)
select doc_id, cast(len(a) as int) as added_line_count, cast(len(r) as int) as removed_line_count,
       md5(array_to_string(a, chr(10))) as added_md5, cast(len(a) as double) as added, cast(len(r) as double) as removed,
       cast(len(a) + len(r) as double) as total_changes, cast(len(a) as double) - len(r) as change_balance from l
""")

_STATS = f"""
stats as (
  select commit_hash, count(*) as f, cast(sum(insertions) as bigint) as a, cast(sum(deletions) as bigint) as d
  from numstat where {SOURCE.format(_PATH)} and not {IGNORED.format(_PATH)} group by 1
)"""


def _size_reason(chars: str, files: int = 5, added: int = 100, deleted: int = 20, limit: int = 5000) -> str:
    return f"""case when coalesce(f, 0) = 0 then 'no_source_files' when f > {files} then 'too_many_changed_files' when a > {added} then 'too_many_added_lines'
       when d > {deleted} then 'too_many_deleted_lines' when {chars} > {limit} then 'patch_too_large' when a + d = 0 then 'no_line_changes' end"""


ORACLE["q_diff_quality"] = with_bindings(["commits", "numstat", "commit_patches"], f"""
with {_STATS}
select repo_id, commit_hash, f as files_changed, a as added_lines, d as deleted_lines, reason, reason is null as accepted
from (select *, {_size_reason('coalesce(length(patch), 0)')} as reason from commits left join stats using (commit_hash) left join commit_patches using (repo_id, commit_hash))
""")


def _positives(limits: str) -> str:
    return f"""
pos as (
  select *, case when parent_count = 0 then 'no_parent' when parent_count > 1 then 'merge' when score < 2 then 'weak_signal'
                 else coalesce({limits}, 'accepted') end as disposition
  from ({POSITIVE_SIGNAL}) left join stats using (commit_hash) left join commit_patches using (repo_id, commit_hash)
)"""


_CHARS = "coalesce(length(patch), 0)"
_SMALL = _size_reason(_CHARS)
_LARGE = _size_reason(_CHARS, 30, 1500, 1500, 80000)
_POS = f"{_STATS}, {_positives(_SMALL)}"
_NEG = f"""{_POS},
neg as (
  select n.*, s.f, s.a, s.d, p.patch,
         case when parent_count = 0 then 'no_parent' when parent_count > 1 then 'merge'
              when n.commit_hash in (select commit_hash from pos where disposition = 'accepted') then 'already_positive'
              when {INTENT} then 'explicit_intent' when {ROUTINE} = 0 then 'no_routine_signal' else coalesce({_SMALL}, 'accepted') end as disposition
  from ({NEGATIVE_SIGNAL}) n left join stats s using (commit_hash) left join commit_patches p using (repo_id, commit_hash)
)"""
_FILES = f"""
lists as (
  select commit_hash, string_agg(file_path || ':' || insertions, ',' order by file_path) as files
  from numstat where {SOURCE.format(_PATH)} and not {IGNORED.format(_PATH)} group by 1
)"""
_FLAT = """repo_id || ':' || commit_hash as record_id, repo_id as repository, case when repo_id in ('repo3', 'repo8') then 'java' else 'Python' end as language,
       score, signals, files, f as files_changed, a as added_lines, d as deleted_lines, md5(patch) as patch_md5, 'p' || commit_hash as parent,
       'https://example.org/' || repo_id as repository_url, 'https://github.com/' || repo_id || '/commit/' || commit_hash as commit_url"""
_CANDIDATE_TABLES = ["commits", "numstat", "commit_patches"]

ORACLE["q_candidates_pos"] = with_bindings(_CANDIDATE_TABLES, f"""
with {_POS}, {_FILES} select {_FLAT} from pos join lists using (commit_hash) where disposition = 'accepted'
""")
ORACLE["q_candidates_neg"] = with_bindings(_CANDIDATE_TABLES, f"""
with {_NEG}, {_FILES} select {_FLAT}, 'negative_v2' as kind from neg join lists using (commit_hash) where disposition = 'accepted'
""")
ORACLE["q_candidates_capped"] = with_bindings(_CANDIDATE_TABLES, f"""
with {_NEG},
r as (select repo_id, commit_hash, cast(row_number() over (partition by repo_id order by ts, commit_hash) as int) as repo_rank from neg where disposition = 'accepted')
select * from r where repo_rank <= 40 order by repo_id, repo_rank limit 350
""")
_COUNTERS = """count(*) filter (disposition not in ({0}) and disposition <> 'accepted') as rejected, count(*) filter (disposition = 'no_parent') as no_parent,
  count(*) filter (disposition = 'merge') as merge_commits, count(*) filter (disposition = 'no_source_files') as no_source_diff, count(*) filter (disposition = 'accepted') as accepted"""
_EARLY = "'no_parent', 'merge', 'weak_signal', 'already_positive', 'explicit_intent', 'no_routine_signal'"
ORACLE["q_extraction_stats_pos"] = with_bindings(_CANDIDATE_TABLES, f"""
with {_POS}
select repo_id, count(*) as commits_seen, count(*) filter (disposition not in ({_EARLY})) as bug_candidates, {_COUNTERS.format(_EARLY)}
from pos group by rollup (repo_id)
""")
ORACLE["q_extraction_stats_neg"] = with_bindings(_CANDIDATE_TABLES, f"""
with {_NEG}
select repo_id, count(*) as commits_seen, count(*) filter (disposition not in ({_EARLY})) as eligible, {_COUNTERS.format(_EARLY)},
  count(*) filter (disposition = 'already_positive') as already_positive, count(*) filter (disposition = 'explicit_intent') as bug_signal,
  count(*) filter (disposition = 'no_routine_signal') as routine_signal_zero
from neg group by rollup (repo_id)
""")

_EVIDENCE_COUNT = "(" + " + ".join(f"cast(regexp_matches(t, {_quoted(p)}, 'i') as int)" for p in rules.STRONG_EVIDENCE_PATTERNS) + ")"
_SUPPORT_COUNT = "(" + " + ".join(f"cast(regexp_matches(t, {_quoted(p)}, 'i') as int)" for p in rules.SUPPORTING_PATTERNS) + ")"
_REJECTED = "(" + " or ".join(f"regexp_matches(t, {_quoted(p)}, 'i')" for p in rules.REJECT_PATTERNS) + ")"
_QUALITY = f"""{_STATS}, {_positives(_LARGE)},
py as (select commit_hash, count(*) filter (ends_with(file_path, '.py')) as py from numstat where {SOURCE.format(_PATH)} and not {IGNORED.format(_PATH)} group by 1),
e as (
  select *, {_EVIDENCE_COUNT} as st, {_SUPPORT_COUNT} as su, regexp_matches(t, {_quoted(rules.TEST_WORD_PATTERN)}) as te
  from pos join py using (commit_hash) where disposition = 'accepted'
),
v as (
  select *, case when st >= 3 then 5 when st = 2 then 4 when st = 1 then 2 else 0 end + case when su >= 2 then 3 when su = 1 then 1 else 0 end
            + te::int + case when score >= 5 then 2 when score >= 3 then 1 else 0 end as points,
         array_to_string(list_filter([
           case when st >= 3 then 'multiple_strong_bug_signals' when st = 2 then 'two_strong_bug_signals' when st = 1 then 'strong_bug_signal' end,
           case when su >= 2 then 'multiple_supporting_signals' when su = 1 then 'supporting_signal' end,
           case when te then 'test_related' end,
           case when score >= 5 then 'strong_original_signal' when score >= 3 then 'moderate_original_signal' end], lambda x: x is not null), ',') as why,
         case when repo_id in ('repo3', 'repo8') then 'non_python_repository' when t = '' then 'empty_commit_message'
              when {_REJECTED} then 'reject_message_pattern' when py = 0 then 'no_python_source_change' when a + d < 1 then 'empty_change'
              when a + d > 100 then 'patch_too_large' when f > 2 then 'too_many_changed_files'
              when coalesce(regexp_replace(patch, '\\s', '', 'g'), '') = '' then 'empty_patch' end as stop
  from e
),
judged as (
  select repo_id || ':' || commit_hash as record_id, stop is null and points >= 4 and st > 0 as accepted,
         cast(case when stop is not null then 0 else points end as int) as score,
         coalesce(stop, concat_ws(',', nullif(why, ''), case when points < 4 then 'insufficient_bug_evidence' when st = 0 then 'no_explicit_bug_signal' end)) as reasons
  from v
)"""
ORACLE["q_quality_verdict"] = with_bindings(_CANDIDATE_TABLES, f"with {_QUALITY} select * from judged")
_CHAIN_NEG = _NEG[len(_POS) + 1 :]
ORACLE["q_dataset_chain"] = with_bindings(_CANDIDATE_TABLES, f"""
with {_QUALITY}, {_CHAIN_NEG},
good as (select j.record_id, p.repo_id, sha256({NORMAL.format("coalesce(patch, '')")}) as b from judged j join pos p on j.record_id = p.repo_id || ':' || p.commit_hash where j.accepted),
single as (select * from good qualify row_number() over (partition by b order by record_id) = 1),
positives as (
  select record_id from (select *, row_number() over (partition by repo_id order by md5('42:' || record_id), record_id) as r, count(*) over (partition by repo_id) as n from single)
  where n >= 2 and r <= 20),
negatives as (select repo_id || ':' || commit_hash as record_id from neg where disposition = 'accepted'),
dataset as (select record_id, 1 as label from positives union all select record_id, 0 from negatives),
placed as (
  select *, case when r <= floor(n * 0.8::double) then 'train' when r <= floor(n * 0.8::double) + floor(n * 0.1::double) then 'validation' else 'test' end as split
  from (select *, row_number() over (partition by label order by md5('42:' || record_id), record_id) as r, count(*) over (partition by label) as n from dataset))
select split || ':' || label as step, count(*) as rows from placed group by 1
union all select 'candidates', count(*) from pos where disposition = 'accepted'
union all select 'accepted', count(*) from good
union all select 'deduplicated', count(*) from single
union all select 'balanced', count(*) from positives
union all select 'negatives', count(*) from negatives
union all select 'dataset', count(*) from dataset
""")
ORACLE["q_reject_top15"] = with_bindings(_CANDIDATE_TABLES, f"""
with {_QUALITY}
select reason, count(*) as records from (select unnest(string_split(reasons, ',')) as reason from judged where not accepted)
group by 1 order by records desc, reason limit 15
""")
ORACLE["q_score_histogram"] = with_bindings(_CANDIDATE_TABLES, f"with {_QUALITY} select score, count(*) as records from judged where accepted group by 1")

# The sequential pass as rounds; rows are left after none of these at the given sizes.
_ROUNDS = []
for _i in range(1, 9):
    _ROUNDS.append(f"""
m{_i} as materialized (select *, o = min(o) over (partition by a) and o = min(o) over (partition by b) as keep from r{_i - 1}),
r{_i} as materialized (select o, a, b from m{_i} where not keep and a not in (select a from m{_i} where keep) and b not in (select b from m{_i} where keep))""")
ORACLE["q_dedup_two_key"] = f"""
with r0 as (select doc_id as o, source || ':' || (n_chars % 40) as a, sha256({NORMAL.format('text')}) as b from documents), {', '.join(_ROUNDS)}
{' union all '.join(f'select o as doc_id from m{i} where keep' for i in range(1, 9))}
"""

_HASH = "md5('42:' || {0})"
_GROUPED = f"""
g as (select doc_id, lang || ':' || source as repo from documents),
k as (select *, row_number() over (partition by repo order by {_HASH.format('doc_id')}, doc_id) as r, count(*) over (partition by repo) as n from g)"""


def _split(rank: str, size: str) -> str:
    return f"case when {rank} <= floor({size} * 0.8::double) then 'train' when {rank} <= floor({size} * 0.8::double) + floor({size} * 0.1::double) then 'validation' else 'test' end"


ORACLE["q_balance"] = f"with {_GROUPED} select doc_id, repo from k where n >= 5 and r <= 30"
ORACLE["q_balance_counts"] = f"with {_GROUPED} select repo, cast(case when n < 5 then 0 else least(n, 30) end as bigint) as kept from (select repo, count(*) as n from g group by 1)"
ORACLE["q_group_split"] = f"with {_GROUPED} select doc_id, repo, case when n < 10 then 'train' else {_split('r', 'n')} end as split from k"

_RANKED_LABELS = f"k as (select *, row_number() over (partition by quality order by {_HASH.format('doc_id')}, doc_id) as r, count(*) over (partition by quality) as n from labels)"
ORACLE["q_balanced_sample"] = f"with {_RANKED_LABELS} select doc_id, quality from k where r <= (select min(c) from (select count(*) as c from labels group by quality))"
ORACLE["q_balanced_changes"] = with_bindings(["file_changes"], f"""
with l as (select commit_hash, file_path, cast({LABEL_OF_CHANGE} as int) as label from file_changes),
k as (select *, row_number() over (partition by label order by {_HASH.format("commit_hash || ':' || file_path")}, commit_hash, file_path) as r from l)
select commit_hash, file_path, label from k where r <= (select min(c) from (select count(*) as c from l group by label))
""")
ORACLE["q_capped_sample"] = f"""
with {_RANKED_LABELS}
select doc_id, quality from k where r <= case when quality = 1 then 200 else least(50, (select least(200, count(*)) from labels where quality = 1)) end
"""

_CLASSES = """
raw as (select *, case when doc_id % 17 = 0 then null when doc_id % 19 = 0 then ' ' else ' d' || doc_id end as rid from labels),
p0 as (select *, 1 as seq from raw where quality = 1 union all select *, 2 from raw where quality = 1 and toxic = 1),
n0 as (select *, 1 as seq from raw where quality = 0 union all select *, 2 from raw where toxic = 1),
p1 as (select *, coalesce(nullif(trim(rid), ''), 'positive:missing_record_id:' || row_number() over (order by doc_id, seq)) as record_id from p0),
n1 as (select *, coalesce(nullif(trim(rid), ''), 'negative:missing_record_id:' || row_number() over (order by doc_id, seq)) as record_id from n0)"""
ORACLE["q_dataset_assemble"] = f"""
with {_CLASSES},
p2 as (select * from p1 qualify row_number() over (partition by record_id order by doc_id, seq) = 1),
n2 as (select * from n1 qualify row_number() over (partition by record_id order by doc_id, seq) = 1)
select record_id, 1 as label, doc_id, seq, cast(null as int) as toxic from p2
union all select record_id, 0, doc_id, seq, toxic from n2 where record_id not in (select record_id from p2)
"""
ORACLE["q_assembly_counts"] = f"""
with {_CLASSES}
select (select count(*) from p1) as positive_rows, (select count(*) from n1) as negative_rows,
       (select count(*) - count(distinct record_id) from p1) as positive_duplicates, (select count(*) - count(distinct record_id) from n1) as negative_duplicates,
       (select count(distinct record_id) from n1 where record_id in (select record_id from p1)) as cross_class_conflicts
"""
ORACLE["q_stratified_split"] = f"with {_RANKED_LABELS} select doc_id, quality as label, {_split('r', 'n')} as split from k"
ORACLE["q_integrity"] = """
select count(*) as rows, count(*) filter (quality = 1) > 0 as has_positives, count(*) filter (quality = 0) > 0 as has_negatives,
       count(*) = count(distinct doc_id) as ids_unique, true as splits_complete from labels
"""
ORACLE["q_duplicate_ids"] = "select count(*) - count(distinct l_orderkey || ':' || l_linenumber) as duplicate_ids from lineitem"
_RANDOM = f"s as (select doc_id, lang, {_split('r', 'n')} as split from (select *, row_number() over (order by {_HASH.format('doc_id')}, doc_id) as r, count(*) over () as n from documents))"
ORACLE["q_random_split"] = f"with {_RANDOM} select * from s"
ORACLE["q_split_distribution"] = f"""
with {_RANDOM}
select split, lang, count(*) as records, round(count(*) * 100.0::double / sum(count(*)) over (partition by split), 2) as percent from s group by 1, 2
"""
ORACLE["q_temporal_split"] = with_bindings(["file_changes"], """
with t as (select commit_hash, min(timestamp) as ts from file_changes group by 1),
k as (select commit_hash, row_number() over (order by ts, commit_hash) - 1 as r, count(*) over () as n from t)
select f.commit_hash, f.file_path, case when r < floor(n * 0.7::double) then 'train' when r < floor(n * 0.85::double) then 'validation' else 'test' end as split
from file_changes f join k using (commit_hash)
""")
_CHANGE_SPLIT = f"""
s as (select *, {_split('r', 'n')} as split from (
  select *, row_number() over (order by {_HASH.format("commit_hash || ':' || file_path")}, commit_hash, file_path) as r, count(*) over () as n from {{0}}))"""
ORACLE["q_leakage"] = with_bindings(["numstat"], f"""
with {_CHANGE_SPLIT.format('numstat')},
c as (select commit_hash, bool_or(split = 'train') as t, bool_or(split = 'validation') as v, bool_or(split = 'test') as e from s group by 1)
select count(*) filter (t and v) as train_validation_overlap, count(*) filter (t and e) as train_test_overlap, count(*) filter (v and e) as validation_test_overlap from c
""")
ORACLE["q_label_stats"] = with_bindings(["file_changes"], f"""
with {_CHANGE_SPLIT.format('file_changes')}
select split, count(*) filter ({LABEL_OF_CHANGE}) as positives, count(*) filter (not {LABEL_OF_CHANGE}) as negatives, count(*) filter (parent_count > 0) as with_history from s group by 1
""")

ORACLE["q_numeric_features"] = with_bindings(_CANDIDATE_TABLES, f"""
with {_STATS},
l as (select commit_hash, count(*) as files, count(*) filter ({SOURCE.format(_PATH)}) as src, count(*) filter ({IS_TEST.format(_PATH)}) as tst, count(*) filter ({IGNORED.format(_PATH)}) as ign
      from numstat group by 1),
v as (
  select commit_hash, cast(coalesce(a, 0) as double) as a, cast(coalesce(d, 0) as double) as d,
         cast(case when coalesce(f, 0) > 0 then f else coalesce(files, 0) end as double) as n,
         cast(coalesce(src, 0) as double) as src, cast(coalesce(tst, 0) as double) as tst, cast(coalesce(ign, 0) as double) as ign,
         coalesce(patch, '') as patch
  from commits left join l using (commit_hash) left join stats using (commit_hash) left join commit_patches using (repo_id, commit_hash)
)
select commit_hash, a as added, d as removed, a + d as total_changes, a - d as change_balance, n as files_changed, src as source_files, tst as test_files,
       ign as ignored_files, round(a / greatest(n, 1), 6) as avg_added, round(d / greatest(n, 1), 6) as avg_removed,
       round((a + d) / greatest(n, 1), 6) as avg_changed, round(src / greatest(n, 1), 6) as source_ratio, round(tst / greatest(n, 1), 6) as test_ratio,
       cast(length(patch) as double) as patch_length,
       cast(case when patch = '' then 0 else length(patch) - length(replace(patch, chr(10), '')) + 1 end as double) as patch_line_count
from v
""")

_SCALED = ["l_quantity", "l_extendedprice", "l_discount"]
ORACLE["q_standardise"] = f"""
select l_orderkey, l_partkey, l_linenumber,
       {', '.join(f'round(({c} - (select avg({c}) from lineitem)) / (select stddev_pop({c}) from lineitem), 5) as {c}' for c in _SCALED)} from lineitem
"""
ORACLE["q_class_weights"] = """
select quality as label, count(*) as records, round((select count(*) from labels)::double / (2 * count(*)), 6) as balanced_weight,
       case when quality = 1 then round((select count(*) from labels where quality = 0)::double / count(*), 6) else 1.0::double end as relative_weight
from labels group by 1
"""


def _terms(word: str) -> str:
    return f"""
w as (select doc_id, regexp_extract_all(lower(text), '{word}') as words from documents),
t as (
  select doc_id, unnest(words) as term from w
  union all select doc_id, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) as term from w
),
tf as (select doc_id, term, count(*) as tf from t group by 1, 2),
voc as (
  select term, cast(sum(tf) as bigint) as corpus_count, count(*) as df from tf group by 1
  having count(*) >= 2 and count(*) <= (select count(*) from documents) * 0.95::double order by corpus_count desc, term limit {rules.MAX_TERMS}
),
idf as (select *, ln((1 + (select count(*) from documents))::double / (1 + df)) + 1 as idf from voc)"""


ORACLE["q_tfidf_vocabulary"] = f"with {_terms(r'[\p{L}\p{N}_]+')} select term, corpus_count, df, round(idf, 6) as idf from idf"
ORACLE["q_tfidf_terms"] = f"""
with {_terms(r'[\p{L}\p{N}_][\p{L}\p{N}_]+')}, raw as (select doc_id, term, tf, (ln(tf) + 1) * idf as x from tf join idf using (term))
select doc_id, term, tf, round(x / sqrt(sum(x * x) over (partition by doc_id)), 6) as weight from raw
"""
# No lookahead here: a mark is put before the last blank of a run that a word follows.
ORACLE["q_pretoken_counts"] = with_bindings(["patches"], r"""
with m as (select regexp_replace(regexp_replace(patch, '^\s+|\s+$', '', 'g'), '(\s)(\S)', chr(1) || '\1\2', 'g') as x from patches)
select token, count(*) as n
from (select unnest(regexp_extract_all(x, '''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x01]+|\s+')) as token from m where x <> '') group by 1
""")

_LENGTHS = "w as (select doc_id, list_transform(string_split(text, ' '), lambda x: length(x)) as ids from documents)"


def _encoded(kept: str, size: int) -> str:
    return f"""
with {_LENGTHS}, k as (select doc_id, list_concat([2], {kept}, [3]) as ids from w)
select doc_id, array_to_string(list_concat(ids, list_transform(range({size} - len(ids)), lambda i: 0)), ' ') as input_ids,
       array_to_string(list_transform(range({size}), lambda i: case when i < len(ids) then 1 else 0 end), ' ') as attention_mask from k
"""


ORACLE["q_encode_fixed"] = _encoded("case when len(ids) <= 63 then ids else list_concat(ids[1:31], ids[len(ids) - 31:len(ids)]) end", 65)
ORACLE["q_encode_prefix"] = _encoded("ids[1:62]", 64)

_CONFUSION = """
c as (select count(*) filter (quality = 1 and toxic = 0) as tp, count(*) filter (quality = 0 and toxic = 0) as fp,
             count(*) filter (quality = 0 and toxic = 1) as tn, count(*) filter (quality = 1 and toxic = 1) as fn from labels)"""
ORACLE["q_confusion"] = f"with {_CONFUSION} select * from c"
ORACLE["q_confusion_matrix"] = "select quality as label, count(*) filter (toxic = 1) as predicted_0, count(*) filter (toxic = 0) as predicted_1 from labels group by 1"
ORACLE["q_metric_values"] = f"""
with {_CONFUSION}
select *, round((tp + tn)::double / (tp + fp + tn + fn), 6) as accuracy, round(coalesce(tp::double / nullif(tp + fp, 0), 0), 6) as precision,
       round(coalesce(tp::double / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp::double / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from c
"""
ORACLE["q_class_report"] = f"""
with {_CONFUSION},
k as (select '1' as class, tp as hit, tp + fp as g, tp + fn as support from c union all select '0', tn, tn + fn, tn + fp from c),
r as (select class, coalesce(hit::double / nullif(g, 0), 0) as p, coalesce(hit::double / nullif(support, 0), 0) as q,
             coalesce(2 * hit::double / nullif(g + support, 0), 0) as f, support from k)
select class, round(p, 6) as precision, round(q, 6) as recall, round(f, 6) as f1, cast(support as bigint) as support from r
union all select 'macro avg', round(avg(p), 6), round(avg(q), 6), round(avg(f), 6), cast(sum(support) as bigint) from r
union all select 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(q * support) / sum(support), 6),
                 round(sum(f * support) / sum(support), 6), cast(sum(support) as bigint) from r
"""
ORACLE["q_prediction_records"] = """
select doc_id as record_id, source as repo_id, lang as commit, quality as true_label, 1 - toxic as predicted_label,
       case when toxic = 1 then 0.75::double else 0.25::double end as probability_non_bug_fix,
       case when toxic = 1 then 0.25::double else 0.75::double end as probability_bug_fix, quality = 1 - toxic as correct
from labels join documents using (doc_id)
"""

_LICENSED = "coalesce(license in ('MIT', 'Apache-2.0', 'BSD-2-Clause', 'BSD-3-Clause', 'ISC'), false)"
_VERDICTS = f"""
s as (
  select *, coalesce(collection_status = 'complete', false) as done, coalesce(commit_count >= 100, false) as c_ok,
         coalesce(source_file_count >= 20, false) as f_ok, coalesce(lower(language) = 'python', false) as py, {_LICENSED} as lic from repositories
),
x as (
  select *, 1 + (not is_fork)::int + (not archived)::int + 2 * c_ok::int + 2 * f_ok::int + py::int + 2 * lic::int as points,
         concat_ws('; ', case when is_fork then 'repository is a fork' end, case when archived then 'repository is archived' end,
           case when commit_count is null then 'commit count unavailable' when not c_ok then 'too few commits: ' || commit_count end,
           case when source_file_count is null then 'source file count unavailable' when not f_ok then 'too few Python files: ' || source_file_count end,
           case when not py then 'unexpected language: ' || coalesce(language, 'None') end,
           case when not lic then 'license not approved or unknown: ' || coalesce(license, 'None') end) as text from s
),
judged as (
  select repo_id, case when not done or is_fork or archived or not c_ok or not f_ok then 'rejected' when points >= 9 then 'high_quality'
                       when points >= 7 then 'accepted' else 'review' end as status,
         cast(case when done then points else 0 end as int) as score,
         case when not done then 'repository collection is not complete' when text = '' then 'repository passed all quality checks' else text end as notes from x
)"""
ORACLE["q_repo_verdict"] = with_bindings(["repositories"], f"with {_VERDICTS} select * from judged")
ORACLE["q_repo_verdict_counts"] = with_bindings(["repositories"], f"""
with {_VERDICTS}
select count(*) filter (status in ('accepted', 'high_quality')) as accepted, count(*) filter (status = 'review') as review, count(*) filter (status = 'rejected') as rejected from judged
""")
ORACLE["q_manifest_notes"] = with_bindings(["repositories"], f"""
with {_VERDICTS}
select repo_id, 'pending' as collection_status, status as quality_status, 'quality_score=' || score || '; ' || notes as notes, 'v1' as dataset_version,
       'manual' as source, clone_url as source_url from judged join repositories using (repo_id)
""")
_MERGED = """
merged as (
  select repo_id, c_custkey, case when c_custkey % 3 > 0 then 'v0' else 'v1' end as dataset_version, coalesce(language, 'python') as language
  from repositories where c_custkey % 3 > 0 or c_custkey % 2 = 0
)"""
ORACLE["q_manifest_upsert"] = with_bindings(["repositories"], f"""
with {_MERGED}, u as (select o_custkey, count(*) as n from orders group by 1)
select repo_id, dataset_version, coalesce(n, 0) as stars, case when n % 2 = 0 then 'main' end as default_branch, 'pending' as collection_status, language
from merged left join u on o_custkey = c_custkey
""")
ORACLE["q_manifest_additions"] = """
select count(*) filter (c_custkey % 3 = 0) as added, count(*) filter (c_custkey % 3 > 0) as skipped from customer where c_custkey % 2 = 0
"""
ORACLE["q_manifest_events"] = """
with e as (select *, epoch_us(o_orderdate) + o_orderkey as moment from orders),
l as (select o_custkey, arg_max(o_orderstatus, moment) as st, arg_max(o_orderpriority, moment) as pr from e group by 1),
d as (select o_custkey, arg_max(o_orderkey, moment) as k, max(moment) as moment from e where o_orderstatus = 'F' group by 1)
select 'cust' || c_custkey as repo_id, case st when 'F' then 'complete' when 'O' then 'collecting' when 'P' then 'failed' else 'pending' end as collection_status,
       case when st = 'P' then pr end as collection_error,
       d.k as commit_count, d.k % 100 as source_file_count, d.moment as collected_us
from customer left join l on l.o_custkey = c_custkey left join d on d.o_custkey = c_custkey
"""
ORACLE["q_kept_manifest"] = ORACLE["q_manifest_events"]
ORACLE["q_manifest_summary"] = with_bindings(["repositories"], """
select 'collection' as kind, coalesce(collection_status, 'unknown') as status, count(*) as repositories from repositories group by 1, 2
union all select 'quality', coalesce(quality_status, 'unknown'), count(*) from repositories group by 1, 2
""")
ORACLE["q_repository_counts"] = with_bindings(["file_changes"], """
select repo_id, (select count(*) from commits c where c.repo_id = r.repo_id) as commit_count,
       (select count(distinct file_path) from file_changes f where f.repo_id = r.repo_id and ends_with(file_path, '.py')) as source_file_count
from (select distinct repo_id from commits) r
""")

# --- code graph ------------------------------------------------------------


def _module(path: str) -> str:
    """These paths are plain files below src, tests or web."""
    return f"replace(regexp_replace(regexp_replace({path}, '^src/', ''), '\\.py$', ''), '/', '.')"


ORACLE["q_modules"] = with_bindings(["files", "numstat"], f"""
select {_module('file_path')} as module, max(file_path) as target_path
from (select file_path from files union select file_path from numstat) group by 1
""")

_MODULES = f"mods as (select {_module('file_path')} as module, max(file_path) as path from files group by 1)"


def _target(kind: str, module: str, name: str) -> str:
    """Exact module, then module and name, then shorter and shorter module names (at most three parts here)."""
    look = "(select path from mods where module = {0})"
    parts = f"string_split({module}, '.')"
    member = f"case when {kind} = 'from' and {name} <> '' then {look.format(f'{module} || chr(46) || {name}')} end"
    shorter = [look.format(f"array_to_string({parts}[1:len({parts}) - {k}], '.')") for k in (1, 2)]
    return f"coalesce({look.format(module)}, {member}, {', '.join(shorter)})"


_RESOLVED_IMPORTS = f"""
asked as (select distinct kind, module, name from positioned_imports),
answered as (select *, {_target('kind', 'a.module', 'a.name')} as target_path from asked a),
imp as (
  select i.*, t.target_path from positioned_imports i
  left join answered t on t.kind = i.kind and t.module is not distinct from i.module and t.name is not distinct from i.name
)"""
ORACLE["q_import_resolution"] = with_bindings(["files", "positioned_imports"], f"""
with {_MODULES}, {_RESOLVED_IMPORTS} select file_path, kind, module, name, alias, level, target_path from imp
""")
_VISIBLE = """
vis as (
  select file_path, visible, arg_max(coalesce(module, '~'), position) as bound_module, arg_max(coalesce(case when kind = 'from' then name end, '~'), position) as bound_name
  from (select *, case when kind = 'from' then coalesce(alias, name) else coalesce(alias, string_split(module, '.')[1]) end as visible from positioned_imports)
  where visible is not null and (kind = 'from' or module is not null) group by 1, 2
)"""
ORACLE["q_visible_names"] = with_bindings(["positioned_imports"], f"""
with {_VISIBLE} select file_path, visible, nullif(bound_module, '~') as bound_module, nullif(bound_name, '~') as bound_name from vis
""")
_LOOKUPS = """
fid as (select *, file_path || '::' || qualified_name || '::L' || line_start as id from functions),
known as (select distinct file_path, name as known, id from fid union select distinct file_path, qualified_name, id from fid),
per_file as (select file_path, known, count(*) as n, min(id) as id from known group by 1, 2),
every as (select known, count(distinct id) as n, min(id) as id from known group by 1)"""
ORACLE["q_function_lookup"] = with_bindings(["functions"], f"with {_LOOKUPS} select * from every")

_RESOLVED_CALLS = f"""
{_MODULES}, {_VISIBLE}, {_LOOKUPS},
c1 as (
  select *, case when starts_with(call, 'self.') and parent_class is not null then parent_class || '.' || substr(call, 6) else call end as target,
         string_split(call, '.')[1] as head, case when contains(call, '.') then substr(call, strpos(call, '.') + 1) end as rest
  from callers
),
c2 as (
  select c1.*, coalesce(x.n, y.n) as n1, case when x.n is not null then x.id else y.id end as id1, g.n as n2, g.id as id2,
         v.bound_module as bm, case when v.bound_name = '~' then rest when rest is null then v.bound_name else v.bound_name || '.' || rest end as bn
  from c1 left join per_file x on x.file_path = c1.file_path and x.known = target
  left join per_file y on y.file_path = c1.file_path and y.known = string_split(target, '.')[-1]
  left join every g on g.known = target
  left join vis v on v.file_path = c1.file_path and v.visible = head
),
want as (select distinct bm, bn from c2 where n1 is null and n2 is null and bm <> '~' and bn is not null),
got as (select *, {_target("'from'", 'bm', 'bn')} as path from want),
c3 as (
  select c2.*, coalesce(x.n, y.n) as n3, case when x.n is not null then x.id else y.id end as id3
  from c2 left join got on got.bm = c2.bm and got.bn = c2.bn and n1 is null and n2 is null
  left join per_file x on x.file_path = got.path and x.known = c2.bn
  left join per_file y on y.file_path = got.path and y.known = string_split(c2.bn, '.')[-1]
),
resolved as (
  select fn_no, caller_id, call,
         case when coalesce(n1, n2, n3) = 1 then case when n1 is not null then id1 when n2 is not null then id2 else id3 end end as target_id,
         case when coalesce(n1, n2, n3) = 1 then case when n1 is not null then 'same_file' when n2 is not null then 'direct' else 'import' end end as resolution,
         case when coalesce(n1, n2, n3, 0) = 0 then 'unresolved' when coalesce(n1, n2, n3) = 1 then 'resolved' else 'ambiguous' end as disposition
  from c3
)"""
_CALL_TABLES = ["files", "callers", "positioned_imports"]
ORACLE["q_call_resolution"] = with_bindings(_CALL_TABLES, f"with {_RESOLVED_CALLS} select * from resolved")

_PLAIN = """
q as (select qualified_name, count(*) as n, min(file_path || '::' || qualified_name || '::L' || line_start) as id from functions group by 1),
r as (
  select caller_id, coalesce(n, 0) as n, id from callers left join q on q.qualified_name =
    case when starts_with(call, 'self.') and parent_class is not null then parent_class || '.' || substr(call, 6) else call end
)"""
ORACLE["q_call_graph"] = with_bindings(["callers"], f"with {_PLAIN} select distinct caller_id as src, id as dst from r where n = 1")
ORACLE["q_call_graph_stats"] = with_bindings(["callers"], f"""
with {_PLAIN}
select case when n = 1 then 'resolved' when n > 1 then 'ambiguous' else 'unresolved' end as disposition, count(*) as records from r group by 1
""")

_GRAPH_TABLES = ["files", "classes", "callers", "positioned_imports"]
_GRAPH = f"""
{_RESOLVED_CALLS}, {_RESOLVED_IMPORTS},
ext as (select *, coalesce(module, name) as external from imp where target_path is null and coalesce(module, name) <> ''),
cls as (select *, file_path || '::' || name || '::L' || line_start as id from classes),
nodes as (
  select 'repository:sample' as id, 'repository' as node_type, 'sample' as name, null as file, null as line_start, 'sample' as label
  union all select 'file::' || file_path, 'file', null, null, null, file_path from files
  union all select distinct id, 'class', name, file_path, line_start, name from cls
  union all select id, 'function', max(name), max(file_path), max(line_start), max(qualified_name) from fid group by id
  union all select distinct 'external_module::' || external, 'external_module', external, null, null, external from ext
),
edges as (
  select 'repository:sample' as src, 'file::' || file_path as dst, 'CONTAINS' as relation, null as module, null as imported_name, null as original_call, null as resolution from files
  union all select 'file::' || file_path, id, 'CONTAINS', null, null, null, null from cls
  union all select coalesce(c.id, 'file::' || f.file_path), f.id, 'CONTAINS', null, null, null, null
            from fid f left join cls c on c.file_path = f.file_path and c.name = f.parent_class
  union all select 'file::' || file_path, 'file::' || target_path, 'IMPORTS_INTERNAL', module, name, null, null from imp where target_path is not null
  union all select 'file::' || file_path, 'external_module::' || external, 'IMPORTS_EXTERNAL', null, name, null, null from ext
  union all select caller_id, target_id, 'CALLS', null, null, call, resolution from resolved where target_id is not null
)"""
ORACLE["q_graph_nodes"] = with_bindings(_GRAPH_TABLES, f"with {_GRAPH} select * from nodes")
ORACLE["q_graph_edges"] = with_bindings(_GRAPH_TABLES, f"with {_GRAPH} select * from edges")
ORACLE["q_graph_stats"] = with_bindings(_GRAPH_TABLES, f"""
with {_GRAPH}
select count(*) filter (disposition = 'resolved') as resolved_calls, count(*) filter (disposition = 'ambiguous') as ambiguous_calls,
       count(*) filter (disposition = 'unresolved') as unresolved_calls, (select count(*) from imp where target_path is not null) as internal_imports,
       (select count(*) from ext) as external_imports, count(*) filter (resolution = 'direct') as direct_resolved,
       count(*) filter (resolution = 'same_file') as same_file_resolved, count(*) filter (resolution = 'import') as import_resolved from resolved
""")
ORACLE["q_graph_histograms"] = with_bindings(_GRAPH_TABLES, f"""
with {_GRAPH}
select node_type as name, count(*) as records from nodes group by 1 union all select relation, count(*) from edges group by 1
""")
ORACLE["q_first_edges"] = """
select 'part' || l_partkey as src, 'supplier' || l_suppkey as dst, 'SUPPLIES' as relation,
       min(p_name) as src_name, min(p_brand) as src_file, min(s_name) as dst_name, min('nation' || s_nationkey) as dst_file
from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey where l_linenumber = 1 group by 1, 2 order by 1, 2 limit 20
"""
_SUPPLY = """
e as (select distinct 'part' || l_partkey as src, 'supplier' || l_suppkey as dst from lineitem),
s as (select min('part' || p_partkey) as id from part where contains(p_name, 'red w')),
h1 as (select distinct dst as id from e where src in (select id from s)),
h2 as (select distinct src as id from e where dst in (select id from h1) and src not in (select id from s))"""
ORACLE["q_khop"] = f"""
with {_SUPPLY} select id, 0 as step from s union all select id, 1 from h1 union all select id, 2 from h2
"""
ORACLE["q_khop_edges"] = f"with {_SUPPLY} select src, dst from e where src in (select id from s)"

_PARSED = "p_partkey % 9 <> 0"
ORACLE["q_code_structure"] = f"""
select 'src/p' || p_partkey || '.py' as file_path, {_PARSED} as parsed,
       case when {_PARSED} then 3 else 0 end::int as functions, case when {_PARSED} and p_partkey % 4 = 0 then 1 else 0 end::int as classes,
       case when {_PARSED} then 2 else 0 end::int as imports,
       case when {_PARSED} then concat_ws(',', c || 'f' || p_partkey, c || 'inner', 'g' || p_size) else '' end as names,
       case when {_PARSED} then concat_ws(',', 'self.g', 'inner', 'os.path.join', 'os.path.join', 'h' || p_size) else '' end as calls
from (select *, case when p_partkey % 4 = 0 then 'C' || p_partkey || '.' else '' end as c from part)
"""
ORACLE["q_code_summary"] = f"""
select count(*) filter ({_PARSED}) as parsed_files, count(*) filter (not ({_PARSED})) as failed_files, 3 * count(*) filter ({_PARSED}) as functions,
       count(*) filter ({_PARSED} and p_partkey % 4 = 0) as classes, 2 * count(*) filter ({_PARSED}) as imports, count(*) as source_files from part
"""

# --- stored scorer ----------------------------------------------------------

_SCORED = f"""
n as (
  select doc_id, lang, length(patch) as chars, length(patch) - length(replace(patch, chr(10), '')) + 1 as lines,
         len({_lines('patch', '+')}) as a, len({_lines('patch', '-')}) as r from patches
)"""


def _probability(added: str, removed: str) -> str:
    total = f"0.1::double + 0.7::double * ({added} - 10) / 8 - 0.4::double * ({removed} - 10) / 9 + 0.3::double * (chars - 2000) / 1500 - 0.2::double * (lines - 30) / 25"
    return f"1 / (1 + exp(-({total})))"


ORACLE["q_linear_score"] = with_bindings(["patches"], f"""
with {_SCORED}, p as (select doc_id, {_probability('a', 'r')} as p from n)
select doc_id, round(p, 6) as probability, case when p >= 0.31 then 'bug_fix' else 'non_bug_fix' end as prediction from p
""")
ORACLE["q_stream_score"] = with_bindings(["patches"], f"""
with {_SCORED}, p as (select doc_id, {_probability("case when lang = 'de' then 3 else a end", "case when lang = 'de' then 2 else r end")} as p from n where lang <> 'es')
select cast(doc_id as varchar) as record_id, case when p >= 0.51 then 'bug_fix' else 'non_bug_fix' end as prediction, round(p, 6) as probability from p
union all select 'not json ' || doc_id, 'rejected', null from n where lang = 'es'
""")
ORACLE["q_best_model"] = """
with c as (
  select lang as model, count(*) filter (quality = 1 and toxic = 0) as tp, count(*) filter (quality = 0 and toxic = 0) as fp,
         count(*) filter (quality = 1 and toxic = 1) as fn, avg(n_chars) as loss from labels join documents using (doc_id) group by 1
)
select model, round(coalesce(2 * tp::double / nullif(2 * tp + fp + fn, 0), 0), 6) as f1, round(loss, 4) as loss from c order by coalesce(2 * tp::double / nullif(2 * tp + fp + fn, 0), 0) desc, loss, model limit 1
"""

# --- features, fits and applied models -------------------------------------

ORACLE["q_history_columns"] = ORACLE["q_history_features"].replace(
    "select h.commit_hash, h.file_path,", "select * replace ({}) from (select h.commit_hash, h.file_path,", 1
).format(", ".join(f"cast({n} as double) as {n}" for n in rules.HISTORY_FEATURES)) + ")"
ORACLE["q_change_columns"] = with_bindings(["numstat"], r"""
with v as (select *, insertions::double as a, case when deletions > 3 then deletions else 0 end::double as r from numstat)
select commit_hash, file_path, a as added, r as removed, a + r as total_changes, a - r as change_balance,
       coalesce(nullif(flag, 'A'), 'unknown') as change_type, regexp_extract(lower(file_path), '(\.[^./]+)$', 1) as extension from v
""")
ORACLE["q_one_hot"] = """
with l as (select lang, row_number() over (order by lang) - 1 as i from (select distinct lang from documents where lang <> 'fr')),
s as (select source, row_number() over (order by source) - 1 as i from (select distinct source from documents where lang <> 'fr'))
select doc_id, coalesce(l.i, -1)::bigint as change_type, coalesce(s.i, -1)::bigint as extension
from documents d left join l using (lang) left join s using (source)
"""


_WORD, _LONG_WORD = r"[\p{L}\p{N}_]+", r"[\p{L}\p{N}_][\p{L}\p{N}_]+"


def _fit_sql(word: str | None, numerics: list[str], categories: list[str], text: str = "text") -> str:
    """Slopes of the loss at zero weights for every feature of the rows r(id, y, ...); at the fitted ones they are zero.

    Balanced weights give a row of a class with m rows the error (0.5 - y) / (2 m).
    """
    parts = ["select 'intercept' as block, 'intercept' as feature, sum(e) as start from e"]
    steps = ["e as (select *, (0.5::double - y) / (2 * count(*) over (partition by y)) as e from r)"]
    if word:
        steps.append(rf"""
w as (select id, regexp_extract_all(lower({text}), '{word}') as words from r),
t as (select id, unnest(words) as term from w
  union all select id, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) as term from w),
tf as (select id, term, count(*) as tf from t group by 1, 2),
voc as (select term, count(*) as df from tf group by 1
  having count(*) >= 2 and count(*) <= (select count(*) from r) * 0.95::double order by sum(tf) desc, term limit {rules.MAX_TERMS}),
raw as (select id, term, (ln(tf) + 1) * (ln((1 + (select count(*) from r))::double / (1 + df)) + 1) as x from tf join voc using (term)),
x as (select id, term, x / sqrt(sum(x * x) over (partition by id)) as x from raw)""")
        parts.append("select 'term', term, sum(e * x) from x join e using (id) group by term")
    for name in numerics:
        parts.append(
            f"select 'numeric', '{name}', sum(e * ({name} - (select avg({name}) from r)) / (select coalesce(nullif(stddev_pop({name}), 0), 1) from r)) from e"
        )
    parts += [f"select '{name}', {name}, sum(e) from e group by {name}" for name in categories]
    return (
        ",\n".join(steps)
        + f"\nselect block, feature, round(start, 6) + 0.0::double as start, 0.0::double as gradient from (\n{' union all '.join(parts)})"
    )


_TRAIN_RECORDS = rf"""
with {_RANKED_LABELS}, r as (
  select doc_id as id, quality as y, source || chr(10) || chr(10) || patch as joined, patch, lang as change_type, case when lang = 'en' then '.py' else '.js' end as extension,
         len({_lines('patch', '+')})::double as added, len({_lines('patch', '-')})::double as removed, added + removed as total_changes, added - removed as change_balance
  from patches join k using (doc_id) where {_split('r', 'n')} = 'train'
)"""
_CHANGE_NUMERICS = ["added", "removed", "total_changes", "change_balance"]


def _records_fit(text: str, word: str, numerics: list[str], categories: list[str]) -> str:
    return with_bindings(["patches"], f"{_TRAIN_RECORDS},\n{_fit_sql(word, numerics, categories, text)}")


ORACLE["q_lr_text_fit"] = _records_fit("joined", _LONG_WORD, [], [])
ORACLE["q_lr_patch_fit"] = _records_fit("patch", _WORD, [], [])
ORACLE["q_lr_hybrid_fit"] = _records_fit("patch", _WORD, _CHANGE_NUMERICS, ["change_type", "extension"])

_TRAIN_CHANGES = rf"""
with hf as ({ORACLE['q_history_features']}),
h as (select * from file_changes where parent_count > 0),
t as (select commit_hash, min(timestamp) as ts from h group by 1),
k as (select commit_hash, row_number() over (order by ts, commit_hash) - 1 as r, count(*) over () as n from t),
r as (
  select commit_hash || ':' || file_path as id, ({LABEL_OF_CHANGE})::int as y, coalesce(p.patch, '') as text, coalesce(flag, 'unknown') as change_type,
         regexp_extract(lower(file_path), '(\.[^./]+)$', 1) as extension, insertions::double as added, deletions::double as removed,
         added + removed as total_changes, added - removed as change_balance, hf.* exclude (commit_hash, file_path)
  from h join k using (commit_hash) join hf using (commit_hash, file_path) left join patches p on commit_hash = 'c' || p.doc_id
  where k.r < floor(n * 0.7::double)
)"""
ORACLE["q_lr_history_fit"] = with_bindings(["file_changes", "patches"], f"{_TRAIN_CHANGES},\n{_fit_sql(None, rules.HISTORY_FEATURES, [])}")
ORACLE["q_lr_historical_hybrid_fit"] = with_bindings(
    ["file_changes", "patches"], f"{_TRAIN_CHANGES},\n{_fit_sql(_WORD, [*_CHANGE_NUMERICS, *rules.HISTORY_FEATURES], ['change_type', 'extension'])}"
)
ORACLE["q_lr_history_report"] = with_bindings(["file_changes"], f"""
with h as (select * from file_changes where parent_count > 0),
t as (select commit_hash, min(timestamp) as ts from h group by 1),
k as (select commit_hash, row_number() over (order by ts, commit_hash) - 1 as r, count(*) over () as n from t)
select case when r < floor(n * 0.85::double) then 'validation' else 'test' end as split, count(*) as rows,
       count(*) filter ({LABEL_OF_CHANGE}) as positives, true as accuracy_agrees
from h join k using (commit_hash) where r >= floor(n * 0.7::double) group by 1
""")
ORACLE["q_stream_trained"] = "select doc_id, true as agrees from documents"

# --- training in steps --------------------------------------------------------


def _training_history(strengths: list[float], max_steps: int, patience: int) -> str:
    """Accelerated gradient steps one after the other; stops and choices are made afterwards from all steps."""
    scaled = ", ".join(
        f"(f.{x} - (select avg({x}) from f where split = 'train')) / (select stddev_pop({x}) from f where split = 'train') as x{i}"
        for i, x in enumerate(["added", "removed"])
    )
    ctes = [f"""
with {_RANKED_LABELS},
f as (
  select doc_id, quality as y, {_split('r', 'n')} as split, len({_lines('patch', '+')})::double as added, len({_lines('patch', '-')})::double as removed
  from patches join k using (doc_id)),
m as (select y, (sum(count(*)) over ())::double / (2 * count(*)) as w from f where split = 'train' group by y),
z as materialized (select f.split, f.y, m.w, {scaled} from f join m using (y)),
tr as (select * from z where split = 'train'), va as (select * from z where split = 'validation'),
bound as (select count(*)::double as n, sum(w * (x0 * x0 + x1 * x1 + 1)) / count(*) as b from tr),
start0 as (select 0.0::double as w0, 0.0::double as w1, 0.0::double as c)"""]
    for run, strength in enumerate(sorted(strengths)):
        ctes.append(f"s{run}_0 as (select *, w0 as p0, w1 as p1, c as pc from start{run})")
        for step in range(1, max_steps + 1):
            pull = (step - 1) / (step + 2)
            ctes.append(f"""
s{run}_{step} as materialized (
  with a as (select w0 as n0, w1 as n1, c as nc, w0 + {pull!r}::double * (w0 - p0) as a0, w1 + {pull!r}::double * (w1 - p1) as a1, c + {pull!r}::double * (c - pc) as ac from s{run}_{step - 1}),
  e as (select w * (1 / (1 + exp(-(x0 * a0 + x1 * a1 + ac))) - y) as e, x0, x1 from tr, a),
  g as (select sum(e * x0) as g0, sum(e * x1) as g1, sum(e) as gc from e)
  select a0 - (g0 / n + a0 / ({strength!r}::double * n)) / rate as w0, a1 - (g1 / n + a1 / ({strength!r}::double * n)) / rate as w1, ac - gc / n / rate as c, n0 as p0, n1 as p1, nc as pc
  from a, g, (select n, 0.25::double * b + 1 / ({strength!r}::double * n) as rate from bound)),
v{run}_{step} as (
  select {step} as step, w0, w1, c, sum(w * (ln(1 + exp(m)) - y * m)) / sum(w) as loss,
    2.0::double * count(*) filter (m > 0 and y = 1) / (2 * count(*) filter (m > 0 and y = 1) + count(*) filter ((m > 0) <> (y = 1))) as f1
  from (select w, y, w0, w1, c, x0 * w0 + x1 * w1 + c as m from va, s{run}_{step}) group by w0, w1, c)""")
        every = " union all ".join(f"select * from v{run}_{step}" for step in range(1, max_steps + 1))
        ctes.append(f"""
h{run} as materialized (
  with v as ({every}),
  o as (select a.*, not exists (select 1 from v b where b.step < a.step and (b.f1 > a.f1 or (b.f1 = a.f1 and b.loss <= a.loss))) as gain from v a),
  d as (select *, sum(case when gain then 0 else 1 end) over (order by step rows between {patience - 1} preceding and current row) = {patience} as stop from o)
  select {run} as run, {strength!r}::double as strength, *, stop as stopped from d where step <= coalesce((select min(step) from d where stop), {max_steps})),
start{run + 1} as (select w0, w1, c from h{run} where gain order by step desc limit 1)""")
    alls = " union all ".join(f"select * from h{run}" for run in range(len(strengths)))
    return with_bindings(["patches"], ",\n".join(ctes) + f""",
alls as ({alls})
select run, step, strength as c, round(loss, 6) as loss, round(f1, 6) as f1, gain, stopped,
  row_number() over (order by f1 desc, loss, run, step) = 1 as chosen from alls""")


ORACLE["q_model_texts"] = with_bindings(["patches"], """
with r as (select doc_id, case when lang <> 'de' then source else '' end as m, case when lang <> 'fr' then patch else '' end as p from patches)
select doc_id, md5(m || chr(10) || chr(10) || p) as both_md5, md5(p) as alone_md5 from r
""")
ORACLE["q_invalid_labels"] = """
select doc_id, label from (select doc_id, case when doc_id % 7 <> 0 then quality + toxic end as label from labels)
where label is null or label not in (0, 1)
"""
ORACLE["q_training_history"] = _training_history([0.001, 1.0], 6, 2)
ORACLE["q_stream_history"] = ORACLE["q_kept_history"] = ORACLE["q_history_features"]
