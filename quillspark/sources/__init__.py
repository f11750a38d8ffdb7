"""Documents in and out: JSON lines, change logs, tables, batch builds."""
