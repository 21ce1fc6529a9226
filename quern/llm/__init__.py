"""Training-data pipeline operators: ten DataFrame operators and their registered queries."""
