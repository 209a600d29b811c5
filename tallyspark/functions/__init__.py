"""Scalar kernels: functions from columns to columns, JVM-side unless said otherwise."""
