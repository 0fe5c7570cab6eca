"""Clinic billing analytics on Spark.

Reusable DataFrame operators for medical-practice billing tables and three
report plans composed from them:

* ``plans.reports.revenue_journal``   - revenue journal entry report
* ``plans.reports.encounter_report``  - charge/payment ledger rolled up per ticket
* ``plans.reports.visit_payments``    - insurance payments per visit for a patient

Sub-packages:

* ``sources``   - table schemas, loaders, the test-data mapping, report sinks
* ``functions`` - Column expressions (dates, text, money, classification)
* ``operators`` - DataFrame -> DataFrame operators (filters, dims, ledger, ...)
* ``plans``     - report parameters and report pipelines
* ``llm``       - training-data operators (imported by nothing else)
"""

from clinicledger.session import get_spark

__all__ = ["get_spark"]
