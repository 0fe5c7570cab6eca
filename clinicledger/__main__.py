"""Run the reports from the command line.

    python -m clinicledger store      --source DIR --target DIR [--buckets N]
    python -m clinicledger encounter  --tables DIR [--start D] [--end D] [--date-type DOS|DOE] [...]
    python -m clinicledger revenue    --tables DIR --as-of D [--closing D] [--cutoff D] [...]
    python -m clinicledger visit-payments --tables DIR [--patient-id ID]

``--tables`` is a directory with one Parquet directory per billing table
(``{DIR}/patient_visit``, ...), or a copy written by ``store`` in the
bucketed report layout (detected from its marker). Results are shown
(``--show N``) or written partitioned by service month (``--out DIR``).
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from clinicledger.functions.classify import RateSchedule


def _dt(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def _ints(text: str) -> tuple[int, ...]:
    return tuple(int(x) for x in text.split(",") if x)


def _open(spark, path: str):
    from clinicledger.sources.store import is_stored, open_stored
    from clinicledger.sources.tables import load_tables

    return open_stored(spark, path) if is_stored(spark, path) else load_tables(spark, path)


def _emit(df, args, partition_by=("month_of_service",), sort_by=()):
    from clinicledger.sources.sinks import write_report

    if args.out:
        write_report(df, args.out, partition_by=partition_by, sort_by=sort_by)
        print(f"written to {args.out}")
    else:
        df.show(args.show, truncate=False)


def parse(argv: list[str]) -> argparse.Namespace:
    ap = argparse.ArgumentParser(prog="clinicledger")
    ap.add_argument("--master", default=None, help="Spark master (default: the submitter's)")
    sub = ap.add_subparsers(dest="command", required=True)

    st = sub.add_parser("store", help="copy tables into the bucketed report layout")
    st.add_argument("--source", required=True)
    st.add_argument("--target", required=True)
    st.add_argument("--buckets", type=int, default=None)
    st.add_argument("--no-check-keys", action="store_true",
                    help="skip asserting the keys the plans assume unique (one aggregation per table; "
                         "shuffle-free on tables bucketed by their key)")

    def common(p):
        p.add_argument("--tables", required=True)
        p.add_argument("--out", default=None)
        p.add_argument("--show", type=int, default=20)

    en = sub.add_parser("encounter", help="encounter report")
    common(en)
    en.add_argument("--start", type=_dt, default=None, help="default: the report's own quarter")
    en.add_argument("--end", type=_dt, default=None)
    en.add_argument("--date-type", default="DOS", choices=["DOS", "DOE"])
    en.add_argument("--include-resource", type=int, default=1)
    for name in ("doctors", "procedures", "facilities", "companies", "carriers", "batches", "resources"):
        en.add_argument(f"--{name}", type=_ints, default=None, help="comma-separated ids (default: all)")

    rv = sub.add_parser("revenue", help="revenue journal")
    common(rv)
    rv.add_argument("--as-of", type=_dt, required=True, help="rolling 12 months before this date")
    rv.add_argument("--months", type=int, default=12)
    rv.add_argument("--closing", type=_dt, default=None)
    rv.add_argument("--cutoff", type=_dt, default=None)
    rv.add_argument("--date-type", default="DOS", choices=["DOS", "DOE"])
    rv.add_argument("--facilities", type=_ints, default=None)
    rv.add_argument("--carriers", type=_ints, default=None)
    rv.add_argument("--fanout", default="reference", choices=["reference", "distinct"])
    rv.add_argument("--rate-shift-years", type=int, default=0, help="shift the PPS rate dates")

    vp = sub.add_parser("visit-payments", help="insurance payments per visit of one patient")
    common(vp)
    vp.add_argument("--patient-id", default=None)
    return ap.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    args = parse(sys.argv[1:] if argv is None else argv)
    from clinicledger.plans import reports
    from clinicledger.plans.params import EncounterParams, RevenueParams, VisitPaymentParams
    from clinicledger.session import get_spark

    spark = get_spark(args.master)
    if args.command == "store":
        from clinicledger.sources.store import store_tables
        from clinicledger.sources.tables import load_tables

        store_tables(load_tables(spark, args.source), args.target, args.buckets, check_keys=not args.no_check_keys)
        print(f"stored in {args.target}")
        return 0

    t = _open(spark, args.tables)
    if args.command == "encounter":
        window = {k: v for k, v in (("start", args.start), ("end", args.end)) if v is not None}
        p = EncounterParams(
            **window, date_type=args.date_type, include_resource=args.include_resource,
            doctors=args.doctors, procedures=args.procedures, facilities=args.facilities,
            companies=args.companies, carriers=args.carriers, batches=args.batches, resources=args.resources,
            ordered=args.out is None,
        )
        _emit(reports.encounter_report(t, p, sort_keys=args.out is not None), args)
    elif args.command == "revenue":
        kw = {"date_type": args.date_type, "facilities": args.facilities, "carriers": args.carriers,
              "fanout": args.fanout, "rates": RateSchedule().shifted(args.rate_shift_years),
              "ordered": args.out is None}
        if args.closing:
            kw["closing"] = args.closing
        if args.cutoff:
            kw["cutoff"] = args.cutoff.date()
        p = RevenueParams.rolling(args.as_of, args.months, **kw)
        _emit(reports.revenue_journal(t, p, sort_keys=args.out is not None), args)
    elif args.command == "visit-payments":
        patient = args.patient_id or VisitPaymentParams().patient_id
        _emit(reports.visit_payments(t, patient), args, partition_by=(), sort_by=("visit",))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
