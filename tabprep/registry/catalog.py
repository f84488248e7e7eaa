"""Bookkeeping, masking and ordering queries, on views with the shape of the bookkeeping tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as ct
from ..operators.privacy import CHECKED, PATTERNS, checked_numbers, pii_mask, pii_scan
from ..operators.rank import first_n, position_rank, sort_by, top_k
from ..operators.rows import union_append
from .tools import Book, rounded
from .views import VIEWS, over, table

BOOK = Book()
VERSIONS = VIEWS["versions"]
# bookkeeping tables in the shape of the star schema: customers are datasets, orders their versions
DATASETS = """select c_custkey as dataset_id, c_nationkey as user_id, c_name as name, c_custkey * 10 as creation_time,
    c_acctbal < -500 as is_deleted, c_acctbal > 0 as completed from customer"""
PROJECT_DATASETS = "select c_custkey as dataset_id, c_nationkey as project_id, c_mktsegment = 'BUILDING' and c_custkey % 2 = 0 as public from customer"
PROJECT_USERS = """select s_suppkey as pk, s_nationkey as project_id, s_suppkey % 30 as user_id, s_suppkey % 4 as role_id,
    s_acctbal < 0 as is_deleted from supplier"""
MAPPINGS = """select o_orderkey * 8 + 1 as pk, o_custkey as dataset_id, o_orderkey % 7 as version_id,
    o_custkey % 100 + 1 as project_user_id from orders"""
SET_VERSIONS = """select distinct o_custkey as dataset_id, o_orderkey % 5 as version_id, o_custkey % 30 as user_id,
    o_custkey * 100 + o_orderkey % 5 as creation_time, o_custkey % 23 = 0 as is_deleted from orders"""
JOBS = """select o_orderkey as job_id, o_orderkey * 8 + 1 as pdvu_id, o_orderstatus as job_status,
    case when o_orderkey % 3 = 0 then 'preprocess' when o_orderkey % 3 = 1 then 'feature_eng' else 'auto_ml' end as job_type,
    o_orderdate as creation_time, o_orderkey % 19 = 0 as is_deleted from orders"""
SESSIONS = "select event_id, user_id, ts as login_time, event_type from events"
USERS = "select c_custkey as user_id, c_name as name, c_acctbal < -500 as is_deleted from customer"
PERSONAS = "select s_suppkey * 3 as user_id, s_nationkey as role_id from supplier"
PROJECTS = "select n_nationkey as project_id, n_name as name, n_regionkey as creation_user_id from nation"
MODELS = "select p_partkey as model_id, p_name as model_name, p_size as user_id from part"
MODEL_VERSIONS = """select l_partkey as model_id, l_orderkey * 8 + l_linenumber as version_id, l_orderkey as job_id,
    l_returnflag = 'R' as is_deleted from lineitem"""
ROLE_PERMISSIONS = "select c_custkey as role_id, c_custkey % 40 as perm_id, c_acctbal < 0 as is_deleted from customer"
PERMISSIONS = "select s_suppkey % 30 as perm_id, min(s_nationkey % 7) as module_id, max(s_suppkey % 4) as perm_lvl from supplier group by s_suppkey % 30"
MODULES = "select r_regionkey as module_id, r_name as module_name from region"
PROFILED = VERSIONS.replace("is_deleted", "profiling_done")


def view(text):
    return lambda spark, folder: over(spark, folder, text)


BOOK.add(
    "latest_version",
    lambda spark, folder: ct.latest_version(over(spark, folder, VERSIONS), over(spark, folder, DATASETS)),
    f"""with v as ({VERSIONS}), d as ({DATASETS})
        select dataset_id, coalesce(max(version_id), -1)::bigint as version_id from d left join v using (dataset_id) group by 1""",
)
BOOK.add(
    "visible_datasets",
    lambda spark, folder: ct.visible_datasets(
        over(spark, folder, DATASETS),
        over(spark, folder, VERSIONS),
        over(spark, folder, PROJECT_DATASETS),
        over(spark, folder, PROJECT_USERS),
        user_id=7,
    ),
    f"""with v as ({VERSIONS}), d as ({DATASETS}), m as ({PROJECT_DATASETS}), u as ({PROJECT_USERS})
        select d.dataset_id, any_value(d.name) as name, any_value(d.user_id) as user_id, any_value(d.creation_time) as creation_time,
               max(v.creation_time) as last_modified
        from d join v using (dataset_id)
        where not d.is_deleted and d.completed and d.dataset_id in
          (select m.dataset_id from m join u using (project_id) where not u.is_deleted and (u.user_id = 7 or m.public))
        group by d.dataset_id""",
)
BOOK.add(
    "version_listing",
    lambda spark, folder: ct.version_listing(
        over(spark, folder, SET_VERSIONS),
        over(spark, folder, DATASETS),
        over(spark, folder, MAPPINGS),
        over(spark, folder, PROJECT_USERS),
    ),
    f"""with v as ({SET_VERSIONS}), d as (select dataset_id, name from ({DATASETS})), m as ({MAPPINGS}), u as ({PROJECT_USERS}),
        f as (select m.dataset_id, m.version_id, arg_min(u.project_id, m.pk) as created_in_project
              from m join u on m.project_user_id = u.pk group by 1, 2)
        select dataset_id, name, version_id, user_id, creation_time, created_in_project
        from v join d using (dataset_id) left join f using (dataset_id, version_id) where not is_deleted""",
)
BOOK.add(
    "job_history",
    lambda spark, folder: ct.job_history(
        over(spark, folder, JOBS),
        over(spark, folder, MAPPINGS),
        over(spark, folder, PROJECT_USERS),
        job_status="F",
        project_id=[1, 2, 3, 5, 8, 13, 21],
    ).select("job_id", "pdvu_id", "job_status", "job_type", "creation_time", "dataset_id", "version_id", "project_id", "user_id"),
    f"""with j as ({JOBS}), m as ({MAPPINGS}), u as ({PROJECT_USERS})
        select job_id, pdvu_id, job_status, job_type, creation_time, dataset_id, version_id, project_id, user_id
        from j join m on j.pdvu_id = m.pk join u on m.project_user_id = u.pk
        where not j.is_deleted and job_status = 'F' and project_id in (1, 2, 3, 5, 8, 13, 21)""",
)
BOOK.add(
    "user_roles",
    lambda spark, folder: ct.user_roles(over(spark, folder, USERS), over(spark, folder, PERSONAS)),
    f"with u as ({USERS}), p as ({PERSONAS}) select user_id, name, is_deleted, role_id from u left join p using (user_id) where not is_deleted",
)
BOOK.add(
    "last_login",
    lambda spark, folder: ct.last_login(over(spark, folder, USERS), over(spark, folder, SESSIONS)),
    f"""with u as ({USERS}), s as (select user_id, max(ts) as login_time from events group by 1)
        select user_id, name, is_deleted, login_time from u left join s using (user_id)""",
)
BOOK.add(
    "latest_session",
    lambda spark, folder: ct.latest_session(over(spark, folder, SESSIONS), ties="event_id"),
    f"""with s as ({SESSIONS}) select * from s
        qualify row_number() over (partition by user_id order by login_time desc, event_id desc) = 1""",
)
BOOK.add(
    "project_summary",
    lambda spark, folder: ct.project_summary(over(spark, folder, PROJECTS), over(spark, folder, VIEWS["members_now"])),
    f"""with p as ({PROJECTS}), u as ({VIEWS["members_now"]})
        select project_id, any_value(name) as name, any_value(creation_user_id) as creation_user_id, count(*) as number_of_users
        from p join u using (project_id) group by 1""",
)
BOOK.add(
    "permission_names",
    lambda spark, folder: ct.permission_names(
        over(spark, folder, ROLE_PERMISSIONS), over(spark, folder, PERMISSIONS), over(spark, folder, MODULES)
    ),
    f"""with r as ({ROLE_PERMISSIONS}), p as ({PERMISSIONS}), m as ({MODULES}), n as (select * from p left join m using (module_id))
        select role_id, perm_id, module_id, perm_lvl, module_name from r left join n using (perm_id) where not is_deleted""",
)
BOOK.add(
    "membership_diff",
    lambda spark, folder: ct.membership_diff(
        table(spark, folder, "members_want"), table(spark, folder, "members_now"), ["project_id", "user_id"], "role"
    ),
    f"""with a as ({VIEWS["members_want"]}), b as ({VIEWS["members_now"]})
        select coalesce(a.project_id, b.project_id) as project_id, coalesce(a.user_id, b.user_id) as user_id,
          case when b.user_id is null then 'added' when a.user_id is null then 'removed' else 'changed' end as change,
          b.role as before, a.role as after
        from a full join b on a.project_id = b.project_id and a.user_id = b.user_id
        where a.user_id is null or b.user_id is null or a.role <> b.role""",
)
BOOK.add(
    "model_listing",
    lambda spark, folder: ct.model_listing(over(spark, folder, MODELS), over(spark, folder, MODEL_VERSIONS), user_id=12),
    f"""with m as ({MODELS}), v as ({MODEL_VERSIONS})
        select model_id, model_name, user_id, version_id, job_id from m join v using (model_id) where user_id = 12 and not is_deleted""",
)
BOOK.add(
    "current_mapping",
    lambda spark, folder: ct.current_mapping(over(spark, folder, MAPPINGS), ["project_user_id"]),
    f"""with m as ({MAPPINGS}) select *, pk = max(pk) over (partition by project_user_id) as is_current from m""",
)
BOOK.add(
    "lineage",
    lambda spark, folder: ct.lineage(
        over(spark, folder, VERSIONS), over(spark, folder, JOBS), finished=F.col("job_status") == "F"
    ),
    f"""with recursive v as ({VERSIONS}), j as ({JOBS}),
        w as (select dataset_id, max(version_id) as head, max(version_id) as version_id from v group by 1
              union all select w.dataset_id, w.head, v.prev_id from w join v using (dataset_id, version_id) where w.version_id > 1)
        select w.dataset_id, w.head, w.version_id, v.prev_id, v.job_id, j.job_type
        from w join v using (dataset_id, version_id) join j on j.job_id = v.job_id
        where w.version_id > 1 and j.job_status = 'F' and j.job_type in ('preprocess', 'feature_eng')""",
)
BOOK.add(
    "union_append",
    lambda spark, folder: union_append(
        table(spark, folder, "customer").select("c_custkey", "c_acctbal"),
        over(spark, folder, "select s_acctbal as c_acctbal, s_suppkey + 1000000 as c_custkey, s_name as origin from supplier"),
    ),
    """select c_custkey, c_acctbal, null::varchar as origin from customer
       union all select s_suppkey + 1000000, s_acctbal, s_name from supplier""",
)
BOOK.add(
    "profile_pending",
    lambda spark, folder: ct.profile_pending(
        over(spark, folder, DATASETS), over(spark, folder, PROFILED).select("dataset_id", "version_id", "job_id", "profiling_done")
    ),
    f"""with v as ({PROFILED}), d as ({DATASETS}), n as (
          select dataset_id, version_id, job_id, profiling_done from v
          qualify row_number() over (partition by dataset_id order by version_id desc) = 1)
        select n.* from n where not profiling_done and dataset_id in (select dataset_id from d where not is_deleted)""",
)

BOOK.add(
    "pii_mask",
    lambda spark, folder: pii_mask(table(spark, folder, "documents").select("doc_id", "text", "source"), ["text", "source"], "k3y"),
    "select doc_id, "
    + ", ".join(
        f"""substr(translate(list_aggregate(list_transform(range(0, greatest(ceil(length({c}) / 64.0), 1)::bigint),
            lambda b: sha256(sha256('k3y:' || {c}) || ':' || b::varchar)), 'string_agg', ''), '0123456789', 'ghijklmnop'), 1, length({c})) as {c}"""
        for c in ("text", "source")
    )
    + " from documents",
)
SCAN = [(c, p) for c in ("text", "source") for p in PATTERNS]
BOOK.add(
    "pii_scan",
    lambda spark, folder: rounded(pii_scan(table(spark, folder, "documents").select("text", "source"))),
    " union all ".join(
        f"""select '{c}' as "column", '{p}' as pattern, count(*) filter (regexp_matches({c}, '{PATTERNS[p]}')) as matches,
            round(count(*) filter (regexp_matches({c}, '{PATTERNS[p]}')) / count({c})::double, 6) as share from documents"""
        for c, p in SCAN
    ),
)

# the same sums over digits and signs; numbers are planted too, as documents hold few
NUMBERS = """select doc_id, text,
    concat('card 4539-1488-0343-6467, 8273 1232 7352 0569. DE89 3704 0044 0532 0130 00 / GB82WEST12345698765', cast(doc_id % 10 as varchar(12))) as planted from documents"""
NUMBER_SUMS = """with t as ({numbers}), c as (select 'text' as "column", text as x from t union all select 'planted', planted from t),
    m as (select "column", 'card' as kind, x, [regexp_replace(n, '[^0-9]', '', 'g') for n in regexp_extract_all(coalesce(x, ''), '{card}')] as ns from c
        union all select "column", 'iban', x, [replace(n, ' ', '') for n in regexp_extract_all(coalesce(x, ''), '{iban}')] from c),
    v as (select "column", kind, ns, case kind when 'card' then
        [n for n in ns if list_sum([case when i % 2 = 1 then d when d > 4 then 2 * d - 9 else 2 * d end for d, i in [x::integer for x in string_split(reverse(n), '')]]) % 10 = 0]
        else [n for n in ns if list_reduce([0] || [ascii(x) for x in string_split(n[5:] || n[1:4], '')],
            lambda r, a: case when a < 58 then r * 10 + a - 48 else r * 100 + a - 55 end % 97) = 1] end as good from m)
    select "column", kind, sum(len(ns))::bigint as found, sum(len(good))::bigint as valid, count(*) filter (len(good) > 0) as "values" from v group by 1, 2"""
BOOK.add(
    "pii_checked_numbers",
    lambda spark, folder: checked_numbers(over(spark, folder, NUMBERS).select("text", "planted")),
    NUMBER_SUMS.format(numbers=NUMBERS, card=CHECKED["card"], iban=CHECKED["iban"]),
)

BOOK.add(
    "sort_by",
    lambda spark, folder: sort_by(table(spark, folder, "orders"), ["o_orderpriority", "o_totalprice"], [True, False]),
    "select * from orders order by o_orderpriority, o_totalprice desc",
)
BOOK.add(
    "position_rank",
    lambda spark, folder: position_rank(
        table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"),
        ["l_quantity"],
        ["l_orderkey", "l_linenumber"],
    ),
    """select l_orderkey, l_linenumber, l_quantity, row_number() over (order by l_quantity, l_orderkey, l_linenumber) - 1 as position
       from lineitem""",
)
BOOK.add(
    "first_n",
    lambda spark, folder: first_n(table(spark, folder, "orders").orderBy("o_orderkey"), 20),
    "select * from orders order by o_orderkey limit 20",
)
BOOK.add(
    "top_k",
    lambda spark, folder: top_k(table(spark, folder, "orders"), "o_totalprice", 25, ["o_orderkey"]),
    "select * from orders order by o_totalprice desc, o_orderkey limit 25",
)

QUERIES, SQL = BOOK.queries, BOOK.sql
