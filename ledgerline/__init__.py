"""Sales-distribution reporting on Spark DataFrames.

Cleans distributor extracts (invoices, customer returns, sales orders, customers,
routes, prices), removes listed deductions, enriches facts with reference tables,
derives value and case volume, and produces the daily reports. Every step is a
function from DataFrames to a DataFrame. Plans are lazy but for the price reference,
which the fact reports write to the shared folder once, to measure its size.
"""

from ledgerline.params import Params

__all__ = ["Params"]
