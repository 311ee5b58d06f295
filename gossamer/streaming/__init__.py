"""Nothing: the inventory has no streaming operators.

A sequence of systems (time steps, or a matrix whose values change) is a driver loop: see gossamer.plans.krylov.backward_euler
and Hierarchy.rebuild, which keeps splittings and patterns from one system to the next.
"""
